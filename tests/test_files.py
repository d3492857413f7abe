import pytest
import zstandard

from lorekeep.operators import evidence, lineage
from lorekeep.sources import files, transcripts


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """A file that Spark cuts into many splits has the same line numbers as in one piece."""
    texts = {"a.txt": [f"line {n} " + "x" * (n % 90) for n in range(4_000)], "b.txt": ["", "two\r", "", "four"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8_000)
    try:
        got = sorted((r["file"].rpartition("/")[2], r["line"], r["value"]) for r in files.file_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((name, n + 1, v) for name, lines in texts.items() for n, v in enumerate(lines))


def test_transcripts_of_any_size_plain_and_packed(spark, tmp_path):
    lines = ["{bad", *('{"n": %d}' % n for n in range(9_000)), ""]
    (tmp_path / "plain.jsonl").write_text("\n".join(lines))
    (tmp_path / "packed.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    rows = transcripts.read_events(spark, str(tmp_path), "grok").collect()
    for session in ("plain", "packed"):
        mine = sorted((r["line"], r["event"]) for r in rows if r["session"] == session)
        assert mine == [(n + 2, '{"n": %d}' % n) for n in range(9_000)]


def test_capped_lines_and_source_types(spark):
    rows = files.capped(spark.createDataFrame([("short",), ("é" * 300,), (None,)], "value string"), 500).collect()
    assert [(r["value"], r["bytes"], r["oversized"]) for r in rows] == [("short", 5, False), (None, 600, True), (None, None, None)]
    names = ["a/b.md", "a/B.TXT", "a/run.log", "a/Makefile", "a/x.pdf", "a.b/c", ".env"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", files.source_type_error(files.F.col("p")).alias("e")).collect()
    assert {r["p"]: r["e"] for r in got} == {n: None for n in names} | {"a/x.pdf": "unsupported source type .pdf"}


def test_histories_of_any_length(spark):
    """Paths double, so a chain of 300 decisions takes few rounds and loses no ancestor; a cycle ends."""
    rows = [(f"d{k}", [f"d{k - 1}"] if k else []) for k in range(300)] + [("x", ["y"]), ("y", ["x"])]
    got = {(r["id"], r["ancestor"]) for r in evidence.ancestors(spark.createDataFrame(rows, "id string, supersedes array<string>"), "supersedes").collect()}
    assert got == {(f"d{a}", f"d{b}") for a in range(300) for b in range(a)} | {("x", "y"), ("y", "x")}


def test_a_cluster_must_name_its_folder(spark):
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))})

    class Session:
        sparkContext = Context  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError):
        lineage.use_checkpoints(Session)
