"""The pipeline's stages against their operators' brute force, on a small table folder."""

import random

import pytest

import corpus_pipeline
from folioflow.llm import decontaminate, queries, toxicity

from .conftest import prose
from .test_exact import brute_lines
from .test_simhash import brute_components, brute_fingerprint


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert after == {d: t for d, _, _, t in brute_lines(list(before.items()), 10)}
        elif name == "simhash":
            groups = brute_components([brute_fingerprint(t) for t in before.values()], 4)
            least = {}
            for d, t in before.items():
                g = groups[brute_fingerprint(t)]
                least[g] = min(d, least.get(g, d))
            assert set(after) == set(least.values())
        else:
            assert all(after[d] == before[d] for d in after)
            assert len(after) < len(before) or name == "toxicity"  # the smallest table has too few labels to learn a term
        docs = out
        counts.append(len(after))
    assert counts[-1] > counts[0] / 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_near_copies_under_one_id(spark):
    """Only near copies go: rows with a null id, or one id on different texts, are documents of their own."""
    rng = random.Random(3)
    a, b, c, d, e, f = (prose(rng, 80) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (7, e), (None, e), (5, a), (None, f), (None, f), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    want = [(5, a), (None, b), (None, c), (7, d), (7, e), (None, f), (9, None)]
    assert len({brute_fingerprint(t) for t in (a, b, c, d, e, f)}) == 6
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, want))


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, columns of any name, and no rows at all."""
    rng = random.Random(9)
    toxic = [prose(rng, 30) + " vile rotten foul " + prose(rng, 5) for _ in range(60)]
    clean = [prose(rng, 60) for _ in range(120)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "version", "row", "id", "first", "leak", "Keep", "key", "__doc"]
    cells = lambda i, t: tuple([i, t, None, None, None] + [f"{c}{i}" for c in names[5:]])
    item = prose(rng, 40)
    line = "every tenth document has this line"
    rows = [cells(i, t + ("\n" + line if i % 3 == 0 else "")) for i, t in enumerate(toxic + clean)]
    rows += [cells(500, clean[0] + " " + item), cells(501, clean[1] + " more"), cells(None, prose(rng, 50)), cells(None, prose(rng, 50)), cells(None, None), cells(7000, ""), cells(7001, line)]
    rows += [rows[100], rows[100], cells(100, prose(rng, 50))]
    schema = ", ".join(f"`{c}` {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names)
    sf = str(tmp_path)
    spark.createDataFrame([(i, int(i < 60)) for i in range(180)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == names
        assert stage(spark, docs.limit(0), sf).count() == 0
        got = out.collect()
        assert all(r["__doc"] == f"__doc{r['doc_id']}" and r["Keep"] == f"Keep{r['doc_id']}" and r["version"] == f"version{r['doc_id']}" for r in got)
        if name == "toxicity":
            assert len(got) < len(rows) - 40 and {500, 501, 7000, None} <= {r["doc_id"] for r in got}
        elif name == "line_dedup":
            assert not any(line in r["text"] for r in got) and all(r["n_chars"] == len(r["text"]) for r in got)
            assert sorted(r["text"] for r in got if r["doc_id"] in (7000, 7001)) == ["", ""]
        elif name == "simhash":
            assert sum(r["doc_id"] == 100 for r in got) == 2 and sum(r["doc_id"] is None for r in got) >= 2
        else:
            assert 500 not in {r["doc_id"] for r in got} and len(got) >= 100
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf_dir, name):
    out = queries.QUERIES[name](spark, sf_dir)
    table = "pages" if name == "op9_warc" else "documents"
    rows = out.toPandas()
    whole = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert len(rows) == whole or name == "op10_decontaminate" and 0 < len(rows) < whole
    if name in queries.ORACLES:
        import duckdb

        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        want = con.execute(queries.ORACLES[name]).df()
        key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()))
        assert key(rows) == key(want)


def test_stages_are_fitted_on_all_that_they_get(spark, tmp_path, monkeypatch):
    """More documents than a sample would have: the label model weighs all that are not held out, the basis all passages."""
    n, weights, label_model, taken, products = 80_000, [], toxicity.label_model, [], decontaminate._products
    monkeypatch.setattr(toxicity, "label_model", lambda votes, weight, *more: weights.append(weight.sum()) or label_model(votes, weight, *more))
    monkeypatch.setattr(decontaminate, "_products", lambda rows, right, weight: taken.append((right, weight, products(rows, right, weight))) or taken[-1][2])
    docs = spark.range(n).selectExpr("id doc_id", "concat(if(id % 9 = 0, 'vile', 'fine'), if(id % 50 = 7, ' alpha ', ' other '), id) text")
    spark.range(n).where("id % 2 = 0").selectExpr("id doc_id", "cast(id % 9 = 0 as int) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "alpha omega sigma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() < n
    assert weights == [docs.where(~toxicity.held_out(docs["doc_id"])).count()]
    assert corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).count() == n
    for right, weight, got in taken:  # alpha is the first word, and stands alone in a fiftieth of the passages
        assert weight[0] > 0 and got[0] == pytest.approx(n // 50 * weight[0] ** 2 * right[0], rel=1e-4)
    assert len(taken) == 2
