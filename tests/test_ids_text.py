from pyspark.sql import functions as F

from caseloom.functions import analyzer, ids, text, vectors
from caseloom.operators import cleaning as C


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_normalizers(spark):
    raw = [" 123.txt ", "0123", "1234567", "abc.txt", "12.txt.txt", "", None]
    assert one(spark, ids.plain_id, *raw) == ["123", "0123", "1234567", "abc", "12.txt", "", None]
    assert one(spark, ids.padded_id, *raw) == ["000123", "000123", "1234567", "abc", "12.txt", "", None]
    assert one(spark, lambda c: ids.padded_id(c, 0), "7.txt") == ["7"]
    assert one(spark, ids.run_id, "12", "1234567", "ab") == ["000012", "1234567", "0000ab"]
    assert one(spark, ids.label_id, "12.txt.txt", "a.txtb") == ["12", "ab"]
    assert one(spark, ids.numeric_id, "0012.txt", "x.txt", " 7 ") == [12, None, 7]
    assert one(spark, ids.paragraph_id, "7.txt", "0012", "a.txt", "1234") == ["007", "012", None, "1234"]
    assert one(spark, lambda c: ids.composed_id(c, F.lit("3")), "12") == ["012003"]


def test_placeholders_and_clean_text(spark):
    t = "a <CITATION_SUPPRESSED> b CITATION_SUPPRESSED\tXCITATION_SUPPRESSED\r\n REFERENCE_SUPPRESSED "
    assert one(spark, lambda c: text.placeholder_count(c, "CITATION_SUPPRESSED"), t, None, "") == [2, 0, 0]
    assert one(spark, text.clean_text, t, None, "  ") == ["a b X", "", ""]


def test_years(spark):
    assert one(spark, text.max_year, "in 1999 and 2026, not 2027", "é1999", "1799 2100", None) == [2026, 0, 0, 0]
    cases = [
        ("Date: May 3, 1999 (heard 1998)\n2005 2005", (1999, "header_explicit")),
        ("Released: soon\nHeard / Judgment rendered: 1 May 2001", (2001, "header_explicit")),
        ("see [1987] SCR 33, 2000", (1987, "neutral_citation")),
        ("2011 FCA 3 and 1990", (2011, "neutral_citation")),
        ("in 1990, 1990, 2003, 2003 and 2010", (2003, "front_regex")),
        ("x" * 12_000 + " in 1950 and 1960", (1960, "fallback_global_max")),
        ("no year 1799", (-1, "missing")),
        (None, (-1, "missing")),
    ]
    assert [tuple(r) for r in one(spark, text.case_year, *[c for c, _ in cases])] == [y for _, y in cases]


def test_summary(spark):
    good = "head\nSummary: The facts.\nMore.\n- Topic 1\nrest"
    assert one(spark, text.summary, good) == ["The facts.\nMore."]
    assert one(spark, text.summary, "no Summary", "Summary: a\nb - Topic no summary", "Summary:" + "\nx" * 30 + "\n- Topic", "Summary:\n- Topic", None) == [None] * 5
    assert one(spark, lambda c: text.with_summary(c, F.lit("S")), "body", "Summary: own") == ["Summary:\nS\nbody", "Summary: own"]


def test_query_texts(spark):
    assert one(spark, text.query_text, "a \tb\n\n c\n", None) == ["a  bc", ""]
    assert one(spark, lambda c: text.query_text(c, 5, 3), "abcdefgh") == ["abc"]
    assert one(spark, text.corpus_text, "a\nb\r\nc", None) == ["abc", ""]
    assert one(spark, lambda c: text.truncated_query(c, 2, 100), "a  b c", "a  b") == ["a b", "a  b"]
    assert one(spark, text.word_count, " a b\n", "", None) == [2, 0, 0]
    assert one(spark, lambda c: text.ngrams(text.tokens(c), 2), "A b, c", "a", None) == [["a b", "b c"], [], []]
    assert one(spark, text.entailment_text, "a\n<FRAGMENT_SUPPRESSED> b") == ["a b"]
    assert one(spark, lambda c: text.relevance_prompt(c, F.lit("d")), "q") == ["Query:qDocument:dRelevant:"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [tuple(r) for r in df.select(vectors.dot("a", "b"), F.round(vectors.cosine("a", "b"), 6)).collect()] == [(24.0, 0.96), (0.0, 0.0)]


def test_year_of_metadata(spark):
    df = spark.createDataFrame([("Date: 1999", {"court": "2001", "Decision-Date": "no", "HEARING day": "2003 and 2005"}), ("Date: 1999", {"court": "2001"}), ("x", None)], "t string, m map<string,string>")
    out = [tuple(r.y) for r in df.select(text.case_year(F.col("t"), F.col("m"), patterns=True).alias("y")).collect()]
    assert out == [(2005, "metadata:HEARING day"), (1999, "header_explicit:" + r"(?im)^\s*Date\s*:\s*(.+)$"), (-1, "missing")]


def test_cleaner(spark):
    def clean(text, **options):
        df = spark.createDataFrame([(text,)], "raw string")
        return C.clean_cases(df, "raw", "out", **options).first().out

    english = lambda _: "en"
    assert clean("junk [1] The [FC] sat.\nIt was [t] he day\nafter.\nLa cour a dit que le droit est.\nZzz qqq.\nThe end of it.") == "The [FC] sat.\nIt was the day after.\n\nThe end of it."
    assert "{FC]" in clean("The [FC] sat.", compat=True)
    assert clean("foo [t] he", detect=english, compat=True) == "foothe" and clean("foo [t] he", detect=english) == "foo the"
    assert clean("x) [t] he [c] ase", detect=english, compat=True) == "x)thecase"
    assert clean("\n<FRAGMENT_SUPPRESSED>\n(a) one;\n(b) two [sic]", detect=english) == "(a) one;\n(b) two "
    assert clean(None) is None and clean("") == ""


def test_language_state():
    lines = {"f": "fr", "e": "en", "x": "de", "u": None}
    assert C.english_lines("f\nx\ne\nx\nu", lines.get) == "\n\ne\nx\nu"


def test_context_and_chunks():
    t = "One is here. CITATION_SUPPRESSED starts this one. Two follows. Then a long one ends CITATION_SUPPRESSED. Last."
    assert C.marked_context(t) == "One is here. CITATION_SUPPRESSED starts this one. Then a long one ends CITATION_SUPPRESSED. Last."
    assert "".join(C.sentences(t)) == t
    assert C.with_lead(t, "Lead one. Lead two.", 512, False).startswith("Lead one. Lead two.One is")
    assert C.with_lead(t, "Lead one. Lead two.", 512, True).startswith("Lead one. One")
    assert C.with_lead("a b c d", "Lead one. Lead two.", 7, False) == "Lead one. a b c d" and C.with_lead("a b", "Lead one.", 2, False) == "a b"
    assert C.token_chunks("Aa bb. Cc dd ee ff gg hh. Ii", 4, 2) == ["Aa bb.", "Cc dd ee ff"]
    assert C.token_chunks(None, 4) == [""] and C.token_chunks("Mr. Smith v. Jones went", 4, 1) == ["Mr. Smith v"]
    assert not C.is_sentence_end("by J. Smith", 5, 6) and C.is_sentence_end("end. Next", 4, 5) and not C.is_sentence_end("the U.S. court", 8, 9)


def test_cleaning_operators(spark, rows):
    df = spark.createDataFrame([("1", "[1] The court sat.", "Sum"), ("2", None, None), ("3", "Summary: x. The court sat.", "Sum")], "case_id string, raw string, s string")
    out = {r.case_id: r.processed for r in C.clean_cases(df, "raw", summary="s").collect()}
    assert out == {"1": "Summary:\nSum\nThe court sat.", "2": None, "3": "Summary: x. The court sat."}
    chunks = C.chunk_texts(df, "case_id", "raw", max_tokens=6, special_tokens=2)
    assert rows(chunks.where("case_id = '2'")) == [("2", 0, "")] and chunks.where("case_id = '1'").count() == 2
    assert C.reference_contexts(df, "raw", "s").count() == 3


def test_english_analyzer(spark):
    known = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
    falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radically radic vietnamization vietnam
    predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit triplicate triplic formative form formalize formal electrical electr
    goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun
    activate activ effective effect probate probat rate rate cease ceas controlling control roll roll as as"""
    words = known.split()
    assert [analyzer.stem(w) for w in words[::2]] == words[1::2]
    assert analyzer.analyzed("The Court's ruling, at 3.14 o'clock: U.S. laws won't be not_here") == ["court", "rule", "3.14", "o'clock", "u.s", "law", "won't", "not_here"]
    assert one(spark, analyzer.english_length, "The courts of appeal", None, "", "of the") == [2, 0, 0, 0]
    assert one(spark, analyzer.english_tokens, "Appeals were allowed") == [["appeal", "were", "allow"]]
