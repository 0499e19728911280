"""Readers and adapters that turn raw input into tables."""
