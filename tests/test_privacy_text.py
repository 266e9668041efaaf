"""Personal data, sanitising and HTML text."""

from pyspark.sql import functions as F

from episcope.functions.text import clean_summary, sanitize_query
from episcope.operators.privacy import detect_pii, scrub_texts


def test_cpf_also_reports_rg(spark):
    df = spark.createDataFrame([("Paciente com CPF 123.456.789-00",)], "text STRING")
    r = detect_pii(df).first()
    assert (r.has_pii, r.pii_types) == (True, ["CPF", "RG"])
    assert scrub_texts(df).first().text == "Paciente com CPF ***.***.***-**"


def test_all_kinds_and_clean_text(spark):
    texts = ["Ligue (11) 98765-4321 ou paciente@example.com", "Texto sem dados pessoais.",
             "RG 12.345.678-9 registrado"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    types = [r.pii_types for r in detect_pii(df).collect()]
    assert types == [["Telefone", "Email"], [], ["RG"]]
    out = [r.text for r in scrub_texts(df).collect()]
    assert out == ["Ligue (**) ****-**** ou ***@***.***", "Texto sem dados pessoais.",
                   "RG **.***.***-* registrado"]
    assert [r.pii_detected for r in scrub_texts(df).collect()] == [True, False, True]


def test_sanitize_query(spark):
    q = "<script>alert('x');</script> SRAG & gripe + (covid) 100%" + "a" * 300
    got = spark.createDataFrame([(q,)], "q STRING").select(sanitize_query(F.col("q"))).first()[0]
    import re
    assert got == re.sub(r"[<>\"'%;()&+]", "", q)[:200]


def test_clean_summary(spark):
    html = ("<p>Boletim aponta <b>aumento</b> de casos de SRAG.</p><script>x()</script>"
            "<!-- c --><style>p{}</style> &amp; mais")
    long = "<p>" + "palavra " * 100 + "</p>"
    df = spark.createDataFrame([(html,), (long,), ("",), (None,)], "h STRING")
    got = [r[0] for r in df.select(clean_summary(F.col("h"))).collect()]
    assert got[0] == "Boletim aponta aumento de casos de SRAG. & mais"
    expected_long = ("palavra " * 100).strip()[:320].rstrip() + "…"
    assert got[1] == expected_long
    assert got[2:] == ["", ""]


def test_entity_decoding_matches_python(spark):
    import html
    from episcope.functions.text import unescape_entities
    cases = ["plain", "a &amp; b", "&amp;lt;p&amp;gt;", "&lt;b&gt; &quot;x&quot; &#39;y&#39; &apos;z&apos;",
             "caf&eacute; &amp; co", "x & y", "&amp", "&am", "&copy; 2026 &middot; site", "&nbsp;&nbsp;",
             "&#x41;&#66;", "&amp;amp;", None, "", "&lt;&amp;&gt;"]
    df = spark.createDataFrame([(c,) for c in cases], "s STRING")
    got = [r[0] for r in df.select(unescape_entities(F.col("s"))).collect()]
    assert got == [None if c is None else html.unescape(c) for c in cases]
