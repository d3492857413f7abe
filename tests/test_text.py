from pyspark.sql import functions as F

from lorekeep.functions import text as X
from lorekeep.operators import evidence as E
from lorekeep.operators import extract
from lorekeep.operators import sessions as S


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("x")).alias("y")).first()["y"]


def test_tokens(spark):
    assert one(spark, "Release_main 部署授權, the API-v2 of", X.tokens) == ["release", "main", "部", "署", "部署", "授", "署授", "權", "授權", "api", "v2"]
    assert one(spark, None, X.tokens) == [] and one(spark, "", X.tokens) == []


def test_bytes_are_cut_at_a_character(spark):
    for text in ("a" * 30, "臺" * 20, "é" * 25, "a臺é" * 9, "short", "𝒳" * 12):
        for most in (20, 21, 22, 23):
            data = text.encode()
            want = text if len(data) <= most else data[: most - 3].decode(errors="ignore") + "..."
            assert one(spark, text, lambda c, m=most: extract.cut_bytes(c, m)) == want


def test_project_keys(spark):
    assert one(spark, " /Home/me/workspace/Team\\App/ ", X.project_key) == "team/app"
    assert one(spark, "./x", X.project_key) == "x" and one(spark, "p:x", X.bare_key) == "x"


def test_exit_codes(spark):
    assert one(spark, "a\nProcess exited with code 3\nb", X.exit_code) == 3
    assert one(spark, "The command exited with code 0.", X.exit_code) == 0
    assert one(spark, '{"exit_code": 7}', X.exit_code) == 7 and one(spark, "no code", X.exit_code) is None


def test_status_words(spark):
    assert [one(spark, s, X.status_word) for s in ("In Progress", " DONE ", "won't-fix", "to do", "huh", None)] == ["in_progress", "completed", "cancelled", "pending", None, None]


def test_searchable_text_takes_strings_and_lists(spark):
    attrs = {"label": "L", "summary": '["one", "", "two"]', "aliases": "[not json", "path": None, "other": "x"}
    assert one(spark, attrs, X.searchable_text, "x map<string,string>") == "L one two [not json"


def test_split_extension(spark):
    for name, want in (("a.tar.gz", ("a.tar", "gz")), ("x.PDF", ("x", "pdf")), ("none", ("none", "")), (".bash", (".bash", "")), ("a.toolong", ("a.toolong", ""))):
        stem, ext = X.split_extension(F.col("x"))
        assert tuple(spark.createDataFrame([(name,)], "x string").select(stem, ext).first()) == want


def test_dice_of_short_texts(spark):
    assert one(spark, "a b", X.bigrams) == ["ab"] and one(spark, "a", X.bigrams) == []


def test_next_action(spark):
    rows = [("do", "it", "checkpoint"), (" ", "it", "task_state"), (None, None, "placeholder")]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").select(S.next_action(F.col("a"), F.col("b")).alias("n"))
    assert [r["n"]["basis"] for r in df.collect()] == [w for _, _, w in rows]


def test_history_errors(spark):
    rows = [("t", "a", 0, [], [], "2026-01-02T00:00:00Z"), ("t", "b", 1, ["a"], ["c"], "2026-01-01T00:00:00Z"), ("t", "c", 2, [], [], "2026-01-03T00:00:00Z"), ("u", "d", 0, ["a"], [], "2026-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "task string, id string, place int, supersedes array<string>, depends_on array<string>, observed_at string")
    assert {(r["id"], r["error"]) for r in E.history_errors(df).collect()} == {("b", "not chronological"), ("b", "unknown or later reference: c"), ("d", "unknown or later reference: a")}


def test_premises(spark):
    rows = [("p", ["a"], [], None, None), ("p", ["a"], ["a"], None, "a source both supports and refutes"), (" ", [], [], "x", "premise identity missing"), ("p", [], [], None, "missing premise must identify the absent fact"), ("p", ["a"], [], "x", "a premise cannot be both missing and evidenced"), ("p", [], [], "x", None)]
    df = spark.createDataFrame([r[:4] for r in rows], "p string, s array<string>, r array<string>, m string")
    assert [x[0] for x in df.select(E.premise_error(F.col("p"), F.col("s"), F.col("r"), F.col("m"))).collect()] == [r[4] for r in rows]
