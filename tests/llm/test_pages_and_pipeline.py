import corpus_pipeline as P
import pytest
from compare import assert_agrees, rows_of
from conftest_llm import SCHEMA, prose
from pyspark.sql import functions as F
from test_dedup import brute_exact, jaccard
from test_text_ops import said

import __spark_entry__ as entry
from lorekeep.llm import host_reputation as H
from lorekeep.llm import queries


def test_reputation_agrees_with_sql(spark, sf):
    assert_agrees(spark, sf, H.op9_host_reputation, H.SQL)


URLS = {
    1: ("https://WWW.Example.COM/en/x?q=/a", "www.example.com", "/en/x", "www.example.com/en/", "allow"), 2: ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    3: ("http://example.com/fr/", "example.com", "/fr/", "com/", "allow"), 4: ("x://a.net/es/#t", "a.net", "/es/", "net/es/", "block"), 5: ("x://net/fr/1", "net", "/fr/1", "net/fr/", "block"),
    6: ("x://a.net/de/", "a.net", "/de/", None, None), 7: ("no scheme/en/", "", "", None, None), 8: (None, "", "", None, None), 9: ("x://com", "com", "", None, None), 10: ("x://notcom/a", "notcom", "/a", None, None),
    11: ("x://com:80/a", "com:80", "/a", None, None), 12: ("://", "", "", None, None), 13: ("a://b.com\n/c\nd?e", "b.com\n", "/c\nd", None, None), 14: ("x://É.com/y://z", "É.com", "/y://z", "com/", "allow"),
}


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "clash") for i, u in URLS.items()], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(6, 1), (6, None), (99, 1)], "page_id long, good int")
    rows = {r["page_id"]: r for r in H.host_reputation(pages, outcomes).collect()}
    assert {i: (r["host"], r["path"], r["rule"]) for i, r in rows.items()} == {i: u[1:4] for i, u in URLS.items()}
    assert all(rows[i]["verdict"] == u[4] for i, u in URLS.items() if u[4]) and {r["verdict"] for r in rows.values()} <= {"allow", "block"}


def test_shrinkage_goes_from_host_to_domain_to_suffix(spark):
    hosts = {"good.a.org": 60, "bad.a.org": 60, "new.a.org": 0, "one.b.org": 1, "x.c.xyz": 40}
    pages, outcomes, n = [], [], 0
    for host, count in hosts.items():
        for k in range(max(1, count)):
            pages.append((n, f"http://{host}/{k}"))
            if count:
                outcomes.append((n, int(host not in ("bad.a.org", "x.c.xyz") or k == 0)))
            n += 1
    rows = {r["host"]: r for r in H.host_reputation(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    mean = {h: rows[h]["mean"] for h in hosts}
    assert mean["good.a.org"] > mean["one.b.org"] > mean["new.a.org"] > mean["bad.a.org"] > 0 and mean["x.c.xyz"] < 0.2
    assert rows["good.a.org"]["verdict"] == "allow" and rows["bad.a.org"]["verdict"] == "block" and all(r["bound"] <= r["mean"] for r in rows.values())


def test_pages_without_anything(spark):
    pages, outcomes = spark.createDataFrame([(1, "x://a.b/"), (1, "x://a.b/"), (None, None)], "page_id long, url string"), spark.createDataFrame([], "page_id long, good int")
    assert H.host_reputation(pages, outcomes).count() == 3
    assert H.host_reputation(pages.limit(0), outcomes).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    """Clean documents, copies, near copies, a leak and junk, with nulls and long texts; and the benchmark."""
    bench = [(k, prose(5_000 + k, 40)) for k in range(5)]
    docs = {k: (said("en", k, 15) + " " + prose(k, 120), "en") for k in range(12)} | {20 + k: (said("fr", k, 80), "fr") for k in range(6)}
    words = docs[3][0].split()
    docs |= {100: (docs[1][0].replace(" ", "\n"), "en"), 101: (docs[1][0], None), 102: (" ".join(["changed", *words[1:]]), "en"), 103: (f"{prose(77, 50)} {bench[2][1]} {prose(78, 50)}", "en")}
    docs |= {200: (None, "en"), 201: ("", "en"), 202: ("12 34 --", "en"), 203: (said("en", 99, 9_000), "en")}
    return docs, bench


def test_pipeline_agrees_with_brute_force(spark, tmp_path, planted):
    docs, bench = planted
    spark.createDataFrame([(i, t, lang, "s", None) for i, (t, lang) in docs.items()], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = {i: t for i, (t, _) in docs.items() if t and any(c.isalpha() for c in t)}
    kept = {i: texts[i] for i, _, _, k, _ in brute_exact(list(texts.items())) if k}
    comp = {i: i for i in kept}
    for _ in range(4):
        for a in kept:
            for b in kept:
                if comp[b] != comp[a] and jaccard(kept[a], kept[b]) >= 0.8:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    kept = {i: t for i, t in kept.items() if comp[i] == i and not any(b in t for _, b in bench)}
    out = P.run(spark, str(tmp_path))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == set(kept) and {1, 100, 101} & set(rows) and 103 not in rows and 102 not in rows
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) and r["text"] == kept[i] for i, r in rows.items())


def test_stages_on_odd_rows(spark, tmp_path, odd):
    spark.createDataFrame([(0, prose(1, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(P.STAGES) <= 5
    for n, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, odd, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        if n + 1 < len(P.STAGES):
            assert spark.read.parquet(str(tmp_path / name)).columns == odd.columns
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_queries_read_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    for name, query in queries.QUERIES.items():
        if name not in ("op4_chat_tree", "op7_decontaminate", "op9_host_reputation"):
            assert rows_of(query(spark, sf).select(F.col("doc_id")).toPandas()) == rows_of(docs.toPandas()), name


