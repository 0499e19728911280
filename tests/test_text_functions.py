"""Text expressions on literal inputs."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import glossary as G
from folioflow.functions import placeholders as PH
from folioflow.functions import text as T
from folioflow.functions import validation as V


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_counts_and_tokens(spark):
    assert values(spark, T.count_alnum, ["Hello, World! 123", "### --- === ***"]) == [13, 0]
    assert values(spark, T.estimate_tokens, ["", "hello world", " \n", "a\xa0b c\u2003d \x1c e"]) == [0, 2, 0, 6]


def test_dehyphenate(spark):
    given = ["distrib-\nuted systems", "implemen-\n  tation", "asynchro-\r\nnous execution", "high-availability cluster", "state-of-the-art model", "ab-\ncd-\nef", "Ção-\nx"]
    want = ["distributed systems", "implementation", "asynchronous execution", "high-availability cluster", "state-of-the-art model", "abcd-\nef", "Ção-\nx"]
    assert values(spark, T.dehyphenate, given) == want


def test_page_numbers(spark):
    yes = ["1", " 42 ", "Page 5", "pág. 12", "- 3 -", "[ 7 ]", "4 / 10", "12 of 30"]
    no = ["Chapter 1: The Beginning", "There are 3 workers in the pool.", "Section 2.1 Overview", ""]
    assert values(spark, T.is_page_number, yes + no) == [True] * 8 + [False] * 4


def test_titles(spark):
    texts = ["# One\n## Two", '---\ntitle: "Front"\n---\n# H', "plain", "## Two"]
    assert values(spark, T.markdown_title, texts) == ["One", "Front", "Documento", "Two"]


def test_eta(spark):
    seconds = [None, "-1", "0.4", "2.5", "59.5", "60", "61", "3600", "3725", "7259.4"]
    assert values(spark, lambda x: T.eta(x.cast("double")), seconds) == ["", "concluído", "~1 s", "~2 s", "~1 min", "~1 min", "~1 min 1 s", "~1 h", "~1 h 2 min", "~2 h"]


def test_errors(spark):
    messages = ["File is password protected", "not a PDF", "corrupt", "disk full", "Permission denied", "x não encontrado", "ollama cannot connect", "other"]
    assert values(spark, T.error_title, messages) == ["PDF com senha", "Arquivo não é PDF", "PDF corrompido", "Disco cheio", "Sem permissão na pasta de destino", "Arquivo não encontrado", "Serviço de tradução indisponível", "Erro na operação"]


def test_answers(spark):
    assert values(spark, T.strip_code_fence, ["```markdown\nx\n```", "```\na\n```", "```\na\n```\nb\n```", " y "]) == ["x", "a", "```\na\n```\nb\n```", "y"]
    long = "### Glossary Rules:\n" + "- x\n" * 2000 + "### Text to Translate to pt-BR:\n\nbody"
    assert values(spark, T.strip_echo, [long, "### Text to Translate to X:\nbody", "body"]) == ["body"] * 3


def test_heading_levels(spark):
    df = spark.createDataFrame([(9, "title"), (0, "text"), (None, "section_header"), (None, "title"), (None, None)], "level int, label string")
    assert [r[0] for r in df.coalesce(1).select(T.heading_level(F.col("level"), F.col("label"))).collect()] == [6, 1, 2, 1, 1]


def test_placeholders(spark):
    texts = ["/etc/app/settings.toml, ./scripts/run.sh, ~/Documents, and config/terms.yaml.", "Use `a b` at https://x.y/z. or `c`", "", "v1.2/3.4", None]
    df = PH.protect(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    rows = df.select("protected", "placeholders", PH.restore(F.col("protected"), F.col("placeholders")).alias("back")).collect()
    assert [r.back for r in rows] == texts and len(rows[0].placeholders) == 4
    assert rows[1].protected == "Use __PH_0__ at __PH_2__ or __PH_1__" and rows[1].placeholders == ["`a b`", "`c`", "https://x.y/z."]
    spoken = spark.createDataFrame([("Consulte __ph_0__ ou __ PH_1 __ e __PH_9__.", ["a", "$1"])], "t string, f array<string>")
    assert spoken.select(PH.restore(F.col("t"), F.col("f"))).first()[0] == "Consulte a ou $1 e __PH_9__."


GLOSSARY = G.Glossary(("bug", "pipeline", "c++"), {"machine learning": "aprendizado de máquina", "thread": "thread"})


def test_glossary(spark):
    texts = ["Fixing a bug in the CI/CD pipeline before tomorrow.", "Bugs and C++ in Machine Learning", "debugging", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: (r.preserve, [tuple(t) for t in r.translate]) for r in G.applicable_terms(df, G.glossary_table(spark, GLOSSARY), ["k"]).collect()}
    assert got == {0: (["bug", "pipeline"], []), 1: (["bug", "c++"], [("machine learning", "aprendizado de máquina")]), 2: ([], []), 3: ([], [])}


@pytest.mark.parametrize(
    ("original", "given", "want"),
    [
        ("The build pipeline failed because of a bug.", "A esteira de integração falhou por causa de um defeito.", "A pipeline falhou por causa de um bug."),
        ("machine learning", "aprendizagem automática e Machine Learning", "aprendizado de máquina e Machine Learning"),
        ("a thread", "um fio de execução", "um thread"),
        ("nothing", "um inseto", "um inseto"),
    ],
)
def test_corrections(spark, original, given, want):
    df = spark.createDataFrame([(original, given)], "o string, t string")
    assert df.select(G.correct(F.col("t"), F.col("o"), GLOSSARY)).first()[0] == want
    from folioflow.operators.local import correct

    assert correct(given, original, GLOSSARY) == want


def test_violations(spark):
    df = spark.createDataFrame([("bug in the machine learning pipeline", "nada")], "o string, t string")
    assert len(df.select(G.violations(F.col("t"), F.col("o"), GLOSSARY)).first()[0]) == 3


VALIDATED = [
    ("", "text", "vazia"),
    ("Aqui está a tradução:\n" + "x" * 40, "y" * 40, "chat"),
    ("Here is the translation: " + "x" * 40, "y" * 40, "chat"),
    ("x" * 50 + " à disposição", "y" * 60, "chat"),
    ("# A\n" + "x" * 40, "# A\n## B\n" + "x" * 40, "títulos"),
    ("- a\n" + "x" * 40, "- a\n- b\n" + "x" * 40, "itens de lista"),
    ("no token " + "x" * 40, "__PH_0__ " + "x" * 40, "placeholders"),
    ("x", "y" * 40, "curto"),
    ("x" * 200, "y" * 40, "longo"),
    ("x" * 200, "short", "texto curto"),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(VALIDATED)] + [(99, "x" * 40, "y" * 40, None)], "i int, r string, o string, w string")
    for row in df.select("i", "w", V.validate(F.col("r"), F.col("o")).alias("v")).collect():
        assert row.v.is_valid == (row.w is None)
        if row.w:
            assert len(row.v.reasons) == 1 and row.w in row.v.reasons[0], row
    kept = spark.createDataFrame([("a __ ph_0 __ b", ["x", "y"])], "r string, f array<string>")
    assert kept.select(V.validate(F.col("r"), F.lit("a b c"), F.col("f"))["reasons"]).first()[0] == ["Divergência de placeholders: esperado ['__PH_0__', '__PH_1__'], ausente(s): ['__PH_1__']"]


def test_ratios_are_rounded_by_their_binary_value(spark):
    # Ties of the decimal form: exact in binary (x.125, x.375, x.625), just below the tie, just above it.
    lengths = [(5, 40), (15, 40), (260, 32), (340, 32), (1625, 40), (517, 200), (535, 200), (503, 200), (1, 200), (40000, 32)]
    df = spark.createDataFrame([(i, "x" * m, "y" * n) for i, (m, n) in enumerate(lengths)], "i int, r string, o string")
    rows = df.orderBy("i").select(V.validate(F.col("r"), F.col("o"))["reasons"].alias("v")).collect()
    want = [f"Tamanho muito curto: razão {m / n:.2f} < mínimo 0.4" if m < n else f"Tamanho muito longo: razão {m / n:.2f} > máximo 2.5" for m, n in lengths]
    assert [row.v for row in rows] == [[w] for w in want]


def test_demote_headings():
    original = "# A\n\ntext\n\n## B\n\nmore"
    assert V.demote_headings("# A\n\n### New\n\ntext\n\n## B\n\nmore", original) == "# A\n\nNew\n\ntext\n\n## B\n\nmore"
    assert V.demote_headings(original, original) == original
    assert V.demote_headings("# X\ntext", "text") == "X\ntext"


def test_demote_is_least_cost():
    import itertools
    import random

    rnd = random.Random(0)
    for _ in range(60):
        make = lambda n: "\n".join(f"{'#' * rnd.randint(1, 3)} h{i}\n{'t' * rnd.randint(0, 30)}" for i in range(n))
        original, text = make(rnd.randint(0, 3)), make(rnd.randint(1, 5))
        spots = lambda t: [(len(m[1]), m.start() / max(1, len(t))) for m in V._HEADING_LINE.finditer(t)]
        a, b = spots(original), spots(text)
        kept = [int(x.split("h")[1].split()[0]) for x in V.demote_headings(text, original).splitlines() if x.startswith("#")]
        if len(b) <= len(a):
            assert V.demote_headings(text, original) == text
            continue
        cost = lambda chosen: sum((a[k][0] != b[i][0]) + abs(a[k][1] - b[i][1]) for k, i in enumerate(chosen))
        assert len(kept) == len(a)
        assert abs(cost(kept) - min(map(cost, itertools.combinations(range(len(b)), len(a))))) < 1e-9
