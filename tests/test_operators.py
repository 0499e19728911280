"""Operators over blocks and chunks, against literal results and plain Python."""

import hashlib
import random
import re

import pytest
from html.parser import HTMLParser

from pyspark.sql import functions as F

from folioflow.functions import glossary as G
from folioflow.operators import assembly, blocks, checkpoints, cleaning, progress, segmentation
from folioflow.operators import translation as R
from folioflow.plans.convert import route, translate_documents
from folioflow.queries import QUERIES
from folioflow.sources import files
from folioflow.sources.settings import ConfigError, Settings, load_glossary, load_settings, load_state
from folioflow.streaming.resume import merge_stream, read_states


def block_table(spark, rows):
    """rows: (pos, page, type, content, label)."""
    return blocks.complete(spark.createDataFrame([(1, *r) for r in rows], "doc_id long, pos int, page int, type string, content string, label string"))


def test_clean(spark):
    rows = [
        (0, 1, "heading", "Chapter 1: Start", "title"), (1, 1, "paragraph", "First page text distrib-\nuted.", "text"), (2, 1, "paragraph", "Page 1", "text"),
        (3, 2, "paragraph", "Concurrency in Practice", "text"), (4, 2, "paragraph", "Second page text.", "text"), (5, 2, "paragraph", "2 of 3", "text"),
        (6, 3, "paragraph", "Concurrency in Practice", "text"), (7, 3, "paragraph", "Third page text.", "text"), (8, 3, "paragraph", "Foot", "page_footer"),
    ]
    out = cleaning.clean(block_table(spark, rows)).orderBy("pos").collect()
    assert [(r.block_id, r.content) for r in out] == [("b0", "Chapter 1: Start"), ("b1", "First page text distributed."), ("b2", "Second page text."), ("b3", "Third page text.")]


def test_clean_groups_pages_by_first_appearance(spark):
    rows = [(0, 5, "paragraph", "a one", "text"), (1, 2, "paragraph", "b two", "text"), (2, 5, "paragraph", "c three", "text")]
    assert [r.content for r in cleaning.clean(block_table(spark, rows)).orderBy("pos").collect()] == ["a one", "c three", "b two"]


def greedy(items, limit, barriers):
    out, open_, run, chunk = [], 0, 0, -1
    for tokens, barrier in items:
        if barriers and barrier:
            chunk += 1
            open_ = run = 0
        elif open_ and run + tokens <= limit:
            open_, run = open_ + 1, run + tokens
        else:
            chunk, open_, run = chunk + 1, 1, tokens
        out.append(chunk)
    return out


def test_packing_equals_the_sequential_fold(spark):
    rnd = random.Random(0)
    docs = {d: [(rnd.choice([0, 1, 5, 30, 90, 150]), rnd.random() < 0.2) for _ in range(rnd.randint(1, 40))] for d in range(40)}
    rows = [(d, i, t, not b) for d, items in docs.items() for i, (t, b) in enumerate(items)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, tokens int, translatable boolean").repartition(5)
    for barriers in (True, False):
        got = {}
        for r in segmentation.assign_chunks(df, 100, barriers).collect():
            got.setdefault(r.doc_id, {})[r.pos] = r.chunk_idx
        for d, items in docs.items():
            assert [got[d][i] for i in range(len(items))] == greedy(items, 100, barriers)


def test_semantic_chunks(spark):
    rows = [(0, 1, "heading", "H", "title"), (1, 1, "paragraph", "p", "text"), (2, 1, "code", "x = 1", "code"), (3, 2, "paragraph", "q", "text"), (4, 2, "table", "|a|", "table"), (5, 2, "image", "i.png", "picture")]
    out = segmentation.semantic_chunks(blocks.renumber(block_table(spark, rows))).orderBy("chunk_idx").collect()
    assert [r.status for r in out] == ["pending", "skipped", "pending", "skipped", "skipped"]
    assert [r.original_text for r in out] == ["# H\n\np", "```\nx = 1\n```", "q", "|a|", "![image](i.png)"]
    assert [(r.page_start, r.page_end) for r in out] == [(1, 1), (1, 1), (2, 2), (2, 2), (2, 2)]


def test_page_runs_and_windows(spark):
    pages = spark.createDataFrame([(1, p, p in (3, 4, 5, 8)) for p in range(1, 11)], "doc_id long, page int, needs_ocr boolean")
    got = sorted((r.first_page, r.last_page, r.needs_ocr) for r in segmentation.page_runs(pages).collect())
    assert got == [(1, 2, False), (3, 5, True), (6, 7, False), (8, 8, True), (9, 10, False)]
    assert sorted((r.first_page, r.last_page) for r in segmentation.page_windows(pages, 3).collect()) == [(1, 3), (4, 6), (7, 9), (10, 10)]
    assert segmentation.page_runs(pages.where("page > 99")).count() == 0
    texts = spark.createDataFrame([(1, 1, "x" * 60), (1, 2, "--"), (1, 3, None)], "doc_id long, page int, text string")
    assert [r.needs_ocr for r in segmentation.pages_needing_ocr(texts).orderBy("page").collect()] == [False, True, True]
    assert [r.needs_ocr for r in segmentation.pages_needing_ocr(texts, mode=True, first=2, last=9).collect()] == [True, True]


def test_assembly(spark):
    rows = [(1, 0, "translated", "# T", "# Título"), (1, 2, "pending", "Untranslated text ", None), (1, 1, "translated", "p", " Parágrafo"), (1, 3, "skipped", "", ""), (2, 0, "skipped", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, chunk_idx int, status string, original string, translated string")
    text = assembly.chunk_markdown(F.col("status"), F.col("original"), F.col("translated"), F.col("original"), F.lit(False))
    got = {r.doc_id: r.markdown for r in assembly.assemble(df.withColumn("markdown", text)).collect()}
    assert got == {1: "# Título\n\nParágrafo\n\nUntranslated text\n", 2: ""}
    failed = df.limit(1).select(*[assembly.chunk_markdown(F.lit("error"), F.lit("o"), F.lit("t"), F.lit(""), F.lit(False), m) for m in ("documented", "reference")]).first()
    assert tuple(failed) == ("<!-- NÃO TRADUZIDO -->\n\no", "o")


def test_complex_tables_and_assets(spark):
    rows = block_table(spark, [(0, 1, "table", "|a|", "table"), (1, 1, "image", "assets/i.png", "picture")])
    rows = rows.withColumns({"html": F.when(F.col("pos") == 0, "<td colspan=2>"), "image_path": F.when(F.col("pos") == 1, "/tmp/i.png"), "chunk_idx": F.lit(0)})
    assert assembly.kept_text(rows).first().kept_text == "<td colspan=2>\n\n![image](assets/i.png)"
    assert [tuple(r) for r in assembly.image_assets(rows, "out").collect()] == [("/tmp/i.png", "out/assets/i.png")]


def test_checkpoints(spark):
    schema = "doc_id long, chunk_idx int, status string, text string, updated_at int"
    states = spark.createDataFrame([(1, 0, "translated", "a", 1), (1, 1, "error", "b", 1), (1, 2, "skipped", "c", 1)], schema)
    changed = checkpoints.upsert(states, spark.createDataFrame([(1, 1, "translated", "B", 2), (1, 3, "pending", None, 2)], schema))
    assert {r.chunk_idx: r.text for r in changed.collect()} == {0: "a", 1: "B", 2: "c", 3: None}
    chunks = spark.range(5).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("chunk_idx"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("translated_text"))
    assert sorted(r.chunk_idx for r in checkpoints.pending(chunks, changed).collect()) == [3, 4]
    assert {r.chunk_idx: (r.status, r.translated_text) for r in checkpoints.resume(chunks, states).collect()}[2] == ("skipped", "c")
    manifest = spark.createDataFrame([("h1", "old")], "sha256 string, model string")
    assert sorted(map(tuple, checkpoints.insert_absent(manifest, spark.createDataFrame([("h1", "new"), ("h2", "new")], manifest.schema)).collect())) == [("h1", "old"), ("h2", "new")]


def test_moving_average(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([2, 4, -1, 6, 8])], "s int, i int, v double")
    got = progress.moving_average(df, "s", "i", "v", 3).orderBy("i").collect()
    assert [r.average for r in got] == [2, 3, 4, 6]


class Queued:
    """Answers in turn; an exception among them is raised."""

    def __init__(self, answers):
        self.answers, self.calls = list(answers), []

    def generate(self, prompt, system, temperature):
        self.calls.append((prompt, temperature))
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_retries_with_feedback():
    client = Queued(["", "Olá mundo"])
    out = R.Translator(client, G.Glossary()).chunk("Hello world", "pending")
    assert out == ("Olá mundo", "translated", None, 2)
    assert "Correction Required" in client.calls[1][0] and client.calls[1][1] > client.calls[0][1]


def test_failures_mark_the_original():
    client = Queued([RuntimeError("down")] * 3)
    assert R.Translator(client, G.Glossary()).chunk("Hello", "pending") == ("<!-- NÃO TRADUZIDO -->\n\nHello", "error", "down", 3)
    assert R.Translator(client, G.Glossary()).chunk("  ", "pending") == ("", "translated", None, 0)
    assert [round(R.attempt_temperature(0.2, k), 1) for k in (1, 2, 3, 9)] == [0.2, 0.4, 0.6, 0.8]


def test_prompt_forms_agree(spark):
    from folioflow.operators.local import prompt

    before, feedback = ("o" * 600, "t"), ["bad"]
    want = prompt("body", "pt-BR", ["bug"], {"a": "b"}, before, feedback)
    fixed = F.array(F.struct(F.lit("a").alias("src"), F.lit("b").alias("dst")))
    got = spark.range(1).select(R.prompt_column(F.lit("body"), "pt-BR", F.array(F.lit("bug")), fixed, F.lit(before[0]), F.lit(before[1]), F.array(F.lit("bad")))).first()[0]
    assert got == want and '..."' not in got.split("o" * 400)[0][-4:] and "..." + "o" * 400 in got


def test_whole_flow_resumes(spark, tmp_path):
    rows = block_table(spark, [(0, 1, "heading", "Title", "title"), (1, 1, "paragraph", "Some text here", "text"), (2, 1, "code", "x", "code")])
    rows = rows.withColumn("doc_id", F.lit(7).cast("long"))
    states = spark.createDataFrame([], "doc_id long, chunk_idx int, status string, text string, error_message string, updated_at timestamp")
    runs = []

    def persist(df):
        path = f"{tmp_path}/{len(runs)}"
        df.write.parquet(path)
        runs.append(spark.read.parquet(path).count())
        return spark.read.parquet(path)

    for _ in range(2):
        states, documents = translate_documents(rows, states, R.EchoGenerator, G.Glossary(), Settings(), persist)
        assert documents.first().markdown == "# Title\n\nSome text here\n\n```\nx\n```\n"
    assert runs == [2, 0]


def test_stream_merges_the_latest(spark, tmp_path):
    schema = spark.createDataFrame([], "doc_id long, chunk_idx int, status string, updated_at int").schema
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "cp"))
    for k in range(3):
        spark.createDataFrame([(1, 0, f"s{k}", k), (1, k + 1, "new", k)], schema).write.mode("append").parquet(source)
        merge_stream(spark, source, schema, target, checkpoint)
        merge_stream(spark, source, schema, target, checkpoint)
    got = {r.chunk_idx: r.status for r in read_states(spark, target, schema).collect()}
    assert got == {0: "s2", 1: "new", 2: "new", 3: "new"}


def test_settings(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[translation]\nchunk_max_tokens = 100\n[ocr]\nlanguages = ["por", "eng"]\n')
    got = load_settings(path)
    assert got.translation.chunk_max_tokens == 100 and got.translation.max_retries == 3 and got.ocr.languages == ("por", "eng")
    for bad in ("[translation]\nchunk_max_tokens = 0", "[translation]\ntemperature = 3.0", "ocr = 1", "[ocr]\nlanguages = []", "[[["):
        path.write_text(bad)
        try:
            load_settings(path)
        except ConfigError:
            continue
        raise AssertionError(bad)
    assert load_settings(tmp_path / "none") == Settings()
    path.write_text('preservar:\n  - bug\ntraduzir_como:\n  "machine learning": "aprendizado"\n')
    assert load_glossary(path) == G.Glossary(("bug",), {"machine learning": "aprendizado"})
    path.write_text("{broken")
    assert load_state(path) == {}


def test_files(spark, tmp_path):
    for name, body in {"a.pdf": b"%PDF-1.4 one\ftwo", "b.pdf": b"", "c.txt": b"x", "d.pdf": b"nope" * 20}.items():
        (tmp_path / name).write_bytes(body)
    rows = files.read_files(spark, str(tmp_path)).withColumn("doc_id", F.element_at(F.split("path", "/"), -1))
    got = {r.doc_id: r.problem for r in rows.select("doc_id", files.pdf_problem(F.col("path"), F.col("content")).alias("problem")).collect()}
    assert got == {"a.pdf": None, "b.pdf": "arquivo vazio (0 bytes)", "c.txt": "extensão", "d.pdf": "cabeçalho PDF não encontrado"}
    docs = rows.where("doc_id = 'a.pdf'").select(F.lit(1).cast("long").alias("doc_id"), "content")
    pages = files.page_texts(docs, files.TextExtractor)
    runs = segmentation.page_runs(segmentation.pages_needing_ocr(pages, 4))
    out = files.extract_blocks(docs, runs, files.TextExtractor).orderBy("pos").collect()
    assert [(r.page, r.content) for r in out] == [(1, "%PDF-1.4 one"), (2, "two")]


def test_routes(spark):
    df = spark.createDataFrame([("pdf", "epub"), (".MD", "markdown"), ("doc", "md")], "a string, b string").coalesce(1)
    got = {r.a: r.steps for r in route(df, F.col("a"), F.col("b")).collect()}
    assert got == {"pdf": ["extract", "segment", "assemble", "export_epub"], ".MD": ["copy"], "doc": None}


class PageText(HTMLParser):
    """Text of h1, p and li elements, each up to its end or the next block."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.out, self.open = [], None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "p", "li"):
            self.out.append([tag, ""])
            self.open = tag
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("h1", "p", "li", "ul", "article", "footer", "body"):
            self.open = None

    def handle_data(self, text):
        if self.open and self.cdata_elem is None:
            self.out[-1][1] += text

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")


def test_html_blocks_have_all_their_text(spark):
    odd = [
        '<ul><li class="a"><a href="/x">One</a></li><li>Two <b>bold</b> end<ul><li><a>Inner</a></li></ul></ul><h1><span>T</span>itle</h1>',
        "<p>a<br>b<br/>c <i>d</i>e<p><b>open<br></p><LI><A>Up</A></LI><p>tail <a>link</a> more</article><footer>no</footer>",
        "<script>var t='<p>no</p>';</script><p>x<!-- <p>no</p> --> y<style>p{}</style></p><p> </p><p>1 < 2 &amp; 3</p><link><pre>no</pre><li>" + "z<b>y</b>" * 20_000 + "</li>",
    ]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").union(spark.createDataFrame([(-1 - k, x) for k, x in enumerate(odd)], "page_id long, html string"))
    kinds = {"h1": "heading", "p": "paragraph", "li": "list_item"}
    want = [(r.page_id, pos, kinds[tag], text.strip()) for r in pages.collect() for pos, (tag, text) in enumerate(PageText(r.html).out) if text.strip()]
    got = [(r.doc_id, r.pos, r.type, r.content) for r in blocks.html_blocks(pages).collect()]
    assert sorted(got) == sorted(want)
    assert [g[3] for g in sorted(got) if g[0] == -1] == ["One", "Two bold end", "Inner", "Title"]
    assert [g[3] for g in sorted(got) if g[0] == -2] == ["a b c de", "open", "Up", "tail link more"]


def test_dehyphenate_query_takes_whole_texts(spark, tmp_path):
    texts = ["na tion al", "ação na tion é", "é-\nb", "aé-\nb", "éa-\n b", "a-\nbé", "a-\néb", "日本 tion x", "日a-\nb", "Straße-\nbahn über-\r\n gang", "a-\nb-\nc", "x1-\ny", "a_-\nb", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def joined(text):
        """ASCII letters, a hyphen, a line end with white space around, ASCII letters, at words' edges."""
        text, out, at = text.replace("tion ", "ti-\n on "), "", 0
        for m in re.finditer(r"\b([a-zA-Z]+)-\s*(?:\r?\n)\s*([a-zA-Z]+)\b", text):
            out, at = out + text[at : m.start()] + m[1] + m[2], m.end()
        return out + text[at:]

    got = {r.doc_id: r.joined_md5 for r in QUERIES["f3_dehyphenate"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else hashlib.md5(joined(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_page_number_lines_of_all_events(spark, tmp_path):
    events = [(0, 7, "error"), (1, 12, "view"), (2, 0, None), (3, 345, "click")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["c2_page_number_lines"](spark, str(tmp_path)).collect()
    assert len(got) == 12 * len(events) and all(sum(r.event_id == i for r in got) == 12 for i, _, _ in events)
    numbers = {"%d", " %d ", "Page %d", "pág. %d", "- %d -", "[ %d ]", "%d / 10", "%d of 30"}
    assert all(r.is_page_number == (r.form in numbers) and r.is_exempt == r.form.startswith(("Chapter", "Section")) for r in got)
    assert all(r.running == re.sub(r"\d+", "#", r.form.replace("%d", "1").lower().strip()) for r in got)


def test_a_document_of_many_lines_is_packed_in_one_go(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 7).cast("int").alias("tokens"), (F.col("id") % 11 > 0).alias("translatable"))
    got = [r.chunk_idx for r in segmentation.assign_chunks(rows, 20).orderBy("pos").collect()]
    want, chunk, run, open_ = [], -1, 0, False
    for i in range(n):
        tokens, barrier = i % 7, i % 11 == 0
        if barrier or not open_ or run + tokens > 20:
            chunk, run = chunk + 1, 0
        run, open_ = run + tokens, not barrier
        want.append(chunk)
    assert got == want


def test_packing_reads_its_blocks_once(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    from folioflow.operators import blocks

    chunks = segmentation.semantic_chunks(blocks.renumber(blocks.text_blocks(spark.read.parquet(str(tmp_path / "d")))))
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


def test_states_hold_for_their_own_text(spark):
    states = spark.createDataFrame([(1, 0, "translated", "A", 1, checkpoints_key("a")), (1, 1, "translated", "B", 1, checkpoints_key("b")), (1, 2, "translated", "C", 1, None)], "doc_id long, chunk_idx int, status string, text string, updated_at int, text_key string")
    chunks = spark.createDataFrame([(1, 0, "a", "pending", None), (1, 1, "changed", "pending", None), (1, 2, "c", "pending", None)], "doc_id long, chunk_idx int, original_text string, status string, translated_text string")
    assert [r.chunk_idx for r in checkpoints.pending(chunks, states).collect()] == [1]
    assert {r.chunk_idx: r.translated_text for r in checkpoints.resume(chunks, states).collect()} == {0: "A", 1: None, 2: "C"}


def checkpoints_key(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_flow_keeps_context_and_merged_tables(spark, tmp_path):
    """A document that was interrupted goes on with the context of its done chunk; a table with merged cells is shown as HTML."""
    from folioflow.queries import ContextGenerator

    merged = "<table><tr><td colspan=2>x</td></tr></table>"
    rows = block_table(spark, [(0, 1, "paragraph", "First text of it", "text"), (1, 1, "table", "| x |", "table"), (2, 1, "paragraph", "Second text of it", "text")])
    rows = rows.withColumn("doc_id", F.lit(7).cast("long")).withColumn("html", F.when(F.col("type") == "table", merged))
    now = "timestamp'2020-01-01'"
    states = spark.sql(f"SELECT 7L AS doc_id, 0 AS chunk_idx, 'translated' AS status, 'Primeiro texto' AS text, CAST(NULL AS STRING) AS error_message, {now} AS updated_at, '{checkpoints_key('First text of it')}' AS text_key")

    def persist(df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/s")
        return spark.read.parquet(f"{tmp_path}/s")

    new, documents = translate_documents(rows, states, ContextGenerator, G.Glossary(), Settings(), persist)
    import hashlib

    mark = hashlib.md5(b"First text of it").hexdigest()[:4]
    assert documents.first().markdown == f"Primeiro texto\n\n{merged}\n\nSecond text of it {mark}\n"
    assert sorted(r.chunk_idx for r in persist(new.where("chunk_idx > 0")).collect()) == [1, 2]


def test_exports(spark, tmp_path):
    from folioflow.sources import export

    text = "# Título <1>\n\nText with & and <b>.\nSecond line\n\n- item\n\n```\ncode  # x\n\n  more\n```\n\n## Two\n\nend\n"
    epub = export.EpubExporter().export(text)
    assert export.read_epub(epub) == text and epub == export.EpubExporter().export(text)
    assert export.validate_epub(epub, None) == (True, "no outside checker found; its step is passed over")
    assert not export.validate_epub(epub[:200], None)[0] and not export.validate_epub(b"", None)[0]
    assert export.read_epub(export.EpubExporter().export("")) == "Documento\n"
    pdf = export.PdfExporter().export(text * 100)
    assert pdf.startswith(b"%PDF-1.4") and pdf.count(b"/Type /Page ") > 3
    start = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf[start:].startswith(b"xref") and all(pdf[int(o) :].startswith(f"{i + 1} 0 obj".encode()) for i, o in enumerate(x.split()[0] for x in pdf[start:].split(b"\n")[3 : 3 + pdf.count(b" 0 obj")]))
    docs = spark.createDataFrame([("a", text), ("b/c", ""), (None, "x"), ("n", None)], "name string, markdown string")
    images = spark.createDataFrame([("i.png", bytearray(b"\x89"))], "name string, content binary")
    done = export.export_documents(docs, export.MarkdownExporter, str(tmp_path / "out"), images).collect()
    assert sorted((r.name, r.bytes) for r in done) == [("a.md", len(text.encode())), ("assets/i.png", 1), ("b/c.md", 0)]
    assert (tmp_path / "out/a.md").read_text() == text and sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["a.md", "c.md", "i.png"]
    files = spark.createDataFrame([(1, bytearray(text.encode()), ["export_epub", "read_epub"]), (2, bytearray(b"x"), ["read_epub"]), (3, None, ["copy"]), (4, bytearray(b"y"), ["extract"]), (5, bytearray(b"z"), ["copy"])], "k int, content binary, steps array<string>")
    got = {r.k: (r.content and bytes(r.content), r.error and r.error.split(":")[0]) for r in export.run_steps(files).collect()}
    assert got == {1: (text.encode(), None), 2: (None, "BadZipFile"), 3: (None, None), 4: (None, "KeyError"), 5: (b"z", None)}
    assert export.markdown_title("x\n\n## B\n\n# A\n") == "A" and export.markdown_title("## B") == "B" and export.markdown_title("") == "Documento"


def test_service_client():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from folioflow.sources import service

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, data):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(data if isinstance(data, bytes) else json.dumps(data).encode())

        def do_GET(self):
            self.answer(200, {"models": [{"name": "m:7b", "size_vram": 5}, {}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            self.answer(*{"m:7b": (200, {"response": "olá"}), "no": (404, {}), "bad": (500, {}), "odd": (200, b"<html>")}[body["model"]])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = lambda m: service.HttpGenerator(f"127.0.0.1:{server.server_port}", m, 5.0, {"num_ctx": 4096})
    assert client("m:7b").generate("p", "s", 0.4) == "olá"
    assert seen == [{"model": "m:7b", "prompt": "p", "stream": False, "options": {"temperature": 0.4, "num_ctx": 4096}, "system": "s"}]
    for model, error in (("no", service.ModelMissing), ("bad", service.ServiceError), ("odd", service.ServiceError)):
        with pytest.raises(error):
            client(model).generate("p", "", 0.2)
    assert client("m:x").preflight() == (True, "") and client("").preflight()[0]
    assert client("n").preflight() == (False, service.NO_MODEL.format(model="n")) and client("m").on_gpu() is True
    translated = R.Translator(client("m:7b"), G.Glossary()).chunk("hello", "pending")
    assert translated[:3] == ("olá", "translated", None)
    server.shutdown()
    server.server_close()
    with pytest.raises(service.ServiceUnavailable):
        client("m:7b").generate("p", "s", 0.2)
    assert client("m:7b").preflight() == (False, service.DOWN) and client("m").on_gpu() is None


def test_jobs_are_watched_and_cancelled(spark):
    import threading
    import time

    from folioflow.operators import progress

    assert progress.run_in_group(spark, "quick", lambda: spark.range(10).count()) == 10
    ended = []

    def slow():
        try:
            progress.run_in_group(spark, "slow", lambda: spark.range(0, 4, 1, 4).foreach(lambda _: time.sleep(60)))
        except Exception as e:
            ended.append(e)

    from pyspark import InheritableThread

    thread = InheritableThread(target=slow)
    thread.start()
    for _ in range(200):
        if progress.group_progress(spark, "slow")[1]:
            break
        time.sleep(0.1)
    assert progress.group_progress(spark, "slow")[1] > 0
    progress.cancel_group(spark, "slow")
    thread.join(40)
    assert not thread.is_alive() and ended
