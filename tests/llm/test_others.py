"""Sharding, vectors, quality, URLs, shared helpers and the pipeline."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import common, neighbours, quality, registry, sharding, urls
from leafmill.llm.ordering import running_total
from tests.helpers import compare
from tests.llm.tables import awkward, crc, near, removed, table


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr("leafmill.llm.ordering.RANGE_ROWS", 7)
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), k, k % 3, rng.randint(0, 9)) for k in range(200)]
    df = spark.createDataFrame(rows, "key long, tie int, g int, v int")
    for group in (None, "g"):
        got = {r.tie: r.s for r in running_total(df, "key", "v", "s", ["tie"], group=group).collect()}
        sums, want = {}, {}
        for key, tie, g, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            own = g if group else 0
            want[tie] = sums.get(own, 0)
            sums[own] = want[tie] + v
        assert got == want


def test_ranges_of_few_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_CUTS", 3)
    df = spark.createDataFrame([(None,), (None,), (4,), (4,), (4,), (9,)], "k long")
    rows = sorted(((r.k is not None, r.k or 0), r.p) for r in common.range_ids(df, "k", 20, "p").collect())
    assert len(rows) == 6 and all(a[1] <= b[1] for a, b in itertools.pairwise(rows)) and len({r for r in rows}) == 3
    assert common.range_ids(df.where("k is null"), "k", 20, "p").count() == 2


@pytest.mark.parametrize("most", [1000, 6])
def test_ranges_rise_with_the_key(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_CUTS", most)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    for parts in (1, 5, 130):
        rows = sorted((r.k, r.p) for r in common.range_ids(df, "k", parts, "p").collect())
        assert all(a[1] <= b[1] for a, b in itertools.pairwise(rows))
        assert max(map(len, (list(v) for _, v in itertools.groupby(rows, key=lambda r: r[1])))) <= 3 * 1000 / parts


def test_stored_tables(spark):
    assert common.store(spark.createDataFrame([], "a int, b string")).count() == 0
    kept = common.store(spark.range(3), "x")
    assert kept.count() == 3
    own = kept.inputFiles()[0].split("://")[-1].lstrip("/")
    assert own.startswith(common.shared_dir(spark).split("://")[-1].strip("/"))
    common.drop_stored(kept)
    assert not os.path.exists("/" + own)


def test_flow():
    arcs = [(0, 1, 4, 1), (0, 2, 2, 0), (1, 3, 3, 1), (2, 1, 2, 0), (2, 3, 1, 5)]
    flow = sharding.min_cost_flow(4, arcs, 0, 3)
    assert sum(f for (_, b, *_), f in zip(arcs, flow) if b == 3) == 4
    assert sum(f * c for f, (*_, c) in zip(flow, arcs)) == 10


@pytest.mark.parametrize("seed", range(6))
def test_plans_move_the_fewest_bytes(seed):
    rng = random.Random(seed)
    sizes = {s: [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 2, 7]))] for s in range(4)}
    counts, shards = {s: len(v) for s, v in sizes.items()}, 3
    rows = sum(counts.values())
    least, more = divmod(rows, shards)
    last = {s: sorted(v)[len(v) - least - 1] for s, v in sizes.items() if s < shards and len(v) > least}
    found = sharding.plan(counts, last, shards)
    bytes_moved = sum(sum(sorted(sizes[s])[:n]) for s, n in found.leave.items())
    after = {s: counts.get(s, 0) - found.leave.get(s, 0) for s in range(shards)}
    for _, to, n in found.moves:
        after[to] += n
    assert sorted(after.values()) == sorted([least] * (shards - more) + [least + 1] * more)
    best = min(sum(sum(sorted(sizes[s])[: max(0, counts[s] - keep)]) for s, keep in enumerate([*capacity, 0])) for capacity in set(itertools.permutations([least] * (shards - more) + [least + 1] * more)))
    assert bytes_moved == best


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def laid_out(spark, docs, old, path, shards, monkeypatch):
    """Rows before and after, and files before and after, of a layout of many small files."""
    monkeypatch.setattr(sharding, "TASK_BYTES", 4000)
    sharding.lay_out(docs, old, path)
    before, files = sharding.read_shards(spark, path, 0).collect(), sharding.files_of(spark, path, 0)[0]
    version = sharding.reshard(spark, path, 0, shards)
    return before, sharding.read_shards(spark, path, version).collect(), files, sharding.files_of(spark, path, version)[0]


def test_reshard(spark, tmp_path, monkeypatch):
    texts = awkward() * 4
    docs = table(spark, texts, shard="clash", extra=1)
    docs = docs.unionByName(docs.where("doc_id in (3, 5)")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    before, rows, *_ = laid_out(spark, docs, F.when(F.col("doc_id") % 3 > 0, F.lit(9)).otherwise(F.lit(2)), f"file://{tmp_path}/s", 5, monkeypatch)
    assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars", "extra", "shard", "slot"]
    check_shards(rows, 5)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None)
    assert sorted(map(key, rows)) == sorted(map(key, before)) == sorted(map(key, docs.collect()))
    assert {r.shard for r in before} == {2, 9}
    assert laid_out(spark, table(spark, []), F.lit(0), f"file://{tmp_path}/e", 5, monkeypatch)[1] == []


def test_files_that_lose_nothing_stay(spark, tmp_path, monkeypatch):
    """Two shards lose a few of their smallest rows: most files keep their path and bytes, and the fewest bytes move."""
    rng = random.Random(5)
    texts = ["x" * rng.randrange(1, 3000) for _ in range(600)]
    owner = [0] * 230 + [1] * 210 + [2] * 160
    docs = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(zip(texts, owner))], "doc_id long, text string, s int").repartition(4)
    path = tmp_path / "s"
    stamp = lambda f: (os.stat("/" + f.removeprefix("file:").lstrip("/")).st_mtime_ns, open("/" + f.removeprefix("file:").lstrip("/"), "rb").read())
    monkeypatch.setattr(sharding, "TASK_BYTES", 20_000)
    sharding.lay_out(docs, F.col("s"), f"file://{path}")
    files = sharding.files_of(spark, f"file://{path}", 0)[0]
    assert len(files) > 30
    bytes_before = {f: stamp(f) for f, *_ in files}
    version = sharding.reshard(spark, f"file://{path}", 0, 3)
    after, rows = sharding.files_of(spark, f"file://{path}", version)[0], sharding.read_shards(spark, f"file://{path}", version).collect()
    check_shards(rows, 3)
    stayed = {f for f, *_ in files} & {f for f, *_ in after}
    assert len(stayed) > 0.8 * len(files) and all(stamp(f) == bytes_before[f] for f in stayed)
    moved = [len(r.text) for r in rows if r.shard != owner[r.doc_id]]
    least = [sorted(len(t) for t, s in zip(texts, owner) if s == k)[: n - 200] for k, n in ((0, 230), (1, 210))]
    assert sorted(moved) == sorted(sum(least, [])) and len(moved) == 40
    again = sharding.reshard(spark, f"file://{path}", version, 3)  # nothing is left to do
    assert sharding.files_of(spark, f"file://{path}", again)[0] == after


def test_many_rows_of_one_size(spark, tmp_path, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).repartition(3)
    _, rows, files, _ = laid_out(spark, docs, F.lit(7), f"file://{tmp_path}/s", 6, monkeypatch)
    check_shards(rows, 6)
    assert sorted(r.doc_id for r in rows) == list(range(500)) and len(files) == 8 and max(f[2] for f in files) < 120


def test_op2(spark, data):
    rows = sharding.op2_min_cost_flow_sharding(spark, data).collect()
    check_shards(rows, 40)
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(d.doc_id, len(d.text.encode()) + 16, crc(d.text.encode())) for d in docs}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def search_plain(vectors, every, most):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    out = {}
    for i in ids:
        if i % every == 0:
            scores = x @ x[ids.index(i)]
            order = sorted((k for k in range(len(ids)) if ids[k] != i), key=lambda k: (-scores[k], ids[k]))[:most]
            out[i] = [(ids[k], scores[k]) for k in order]
    return out


def found(df, every, most):
    out = {}
    for r in neighbours.search(df, F.col("vec_id") % every == 0, most).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_search_of_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = {0: [1.0, 0.0], 2: [1.0, 0.0], 3: [0.5, 0.5], 4: [1.0, 0.0], 5: [-1.0, 0.0], 6: [0.0, 2.0]}
    odd = [(10, None), (12, [0.0, 0.0]), (14, [nan, 1.0]), (16, [inf, 1.0]), (18, [None, 1.0]), (20, [1.0]), (None, [1.0, 1.0]), (22, [])]
    df = spark.createDataFrame([*good.items(), *odd], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got, want = found(df, 2, 3), search_plain(good, 2, 3)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_search_with_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "GROUP", 5)
    rng = np.random.default_rng(1)
    vectors = {k: (rng.normal(size=8) if k % 3 else np.ones(8)).astype(np.float32).tolist() for k in range(400)}
    got = found(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>"), 10, 5)
    want = search_plain(vectors, 10, 5)
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    assert all(got[q] == want[q] or [i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want if q % 3 == 0)


def test_search_among_nearly_equal_vectors(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=16)
    vectors = {k: (rng.normal(size=16) if k % 3 else middle + 0.01 * rng.normal(size=16)).astype(np.float32).tolist() for k in range(1500)}
    got = found(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>"), 25, 10)
    want = search_plain(vectors, 25, 10)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_op5_recall(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    want = search_plain({r.vec_id: r.embedding for r in rows}, 20, 20)
    got = {}
    for r in neighbours.op5_ivf_pq_search(spark, data).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(abs(got[q][i] - s) < 1e-9 for q in want for i, s in want[q] if i in got[q])


def test_tables_give_the_codes_scores():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 10)).astype(np.float32)
    index = neighbours.fit(x, 600)
    own, codes = index.encode(x)
    rows = np.flatnonzero(own == own[0])
    parts = np.concatenate([index.books[m][codes[rows][:, m]] for m in range(neighbours.PARTS)], 1)[:, :10]
    near_ = index.approximate(x[:5], int(own[0]), codes[rows])
    assert np.allclose(near_, x[:5] @ (index.centres[own[0]] + parts).T, atol=1e-4)


def test_quality(spark, data):
    rows = quality.op8_rule_quality(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (crc(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(b == 1 for a, b in held if a == 1)


def test_quality_uses_no_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, turned)


def test_quality_of_odd_tables(spark):
    docs = table(spark, awkward(), score="clash")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.train(docs, spark.createDataFrame([(1, 1), (2, 1), (2, 0), (2, 1)], "doc_id long, quality int")).rules == ()
    names = list(quality.statistics(F.col("text")))
    stats = docs.select(*[c.alias(n) for n, c in quality.statistics(F.col("text")).items()]).collect()
    assert all(r[n] is not None and r[n] >= 0 for r in stats for n in names)
    assert quality.score(docs.limit(0), model).count() == 0


def test_labels_and_rows_that_disagree(spark, monkeypatch):
    """A tie of labels is 1; of several rows of a doc_id the smallest text is learnt from, wherever it stands."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, names: seen.append((x.tolist(), y.tolist())))
    held = [r.doc_id for r in spark.range(50).select(F.col("id").alias("doc_id")).where(~quality.held_out("doc_id")).limit(3).collect()]
    a, b, c = held
    labels = spark.createDataFrame([(a, 1), (a, 0), (b, 0), (b, 0), (b, 1), (c, 1)], "doc_id long, quality int")
    rows = [(a, "a text"), (a, "b much longer text of many words"), (b, "one"), (c, "words words"), (c, None)]
    for own in (rows, rows[::-1]):
        quality.train(spark.createDataFrame(own, "doc_id long, text string").repartition(3), labels)
    assert seen[0] == seen[1] and seen[0][1] == [1.0, 0.0, 1.0]
    quality.train(spark.createDataFrame([(a, "a text"), (b, "one"), (c, "")], "doc_id long, text string"), labels)
    assert seen[2] == seen[0]


def test_expression_equals_rules(spark):
    rng = np.random.default_rng(3)
    x = rng.random((800, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    model = quality.fit(x, y, ["a", "b"])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:100]], "a double, b double")
    got = [r.s for r in df.select(model.expression({"a": F.col("a"), "b": F.col("b")}).alias("s")).collect()]
    holds = lambda rule, r: all((r["ab".index(n)] > v) == up for n, up, v in rule.parts)
    want = [1 / (1 + np.exp(-(model.bias + sum(w.weight for w in model.rules if holds(w, r))))) for r in x[:100]]
    assert np.allclose(got, want)
    assert np.mean((np.array(want) > 0.5) == y[:100]) > 0.97


ODD_URLS = [
    None, "", "no scheme", "http://", "http://Example.COM", "HTTP://a.Example.com/en/", "http://example.com/en/76.html?x#y", "http://notcom/en/", "http://x.net/de/", "http://example.net/de/8",
    "http://sub.example.net/de/81", "http://net/de/x", "http://a.org?/es/", "http://a.org/es/#f", "http://casino-win.example.org/fr/", "http://x.spam.example.net/de/1", "a://b://c/en/", "http://u@h.com:80/en/1",
    "http://com/en/", "http://.com/en/", "ftp://É.com/en/É", "http://spamless.example.org/",
]


def test_urls(spark, duck):
    import duckdb

    df = spark.createDataFrame([(k, u) for k, u in enumerate(ODD_URLS)] + [(0, "http://example.com/en/7")], "page_id long, url string")
    rows = df.collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [tuple(r) for r in rows])
    got = urls.judge(df.withColumn("rule", F.lit("clash"))).drop("url")
    assert compare(got, con.sql(urls.ORACLE)) == len(rows)
    by = {ODD_URLS[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in got.where("page_id > 0").collect()}
    assert by["http://example.com/en/76.html?x#y"] == ("example.com", "/en/76.html", "example.com/en/7", "allow")
    assert by["http://sub.example.net/de/81"][2:] == ("example.net/de/8", "block")
    assert by["http://x.spam.example.net/de/1"][2:] == ("net/de/", "allow") and by["http://casino-win.example.org/fr/"][2:] == (None, "block")
    assert by["http://net/de/x"][2] == "net/de/" and by["http://notcom/en/"][2] is None
    assert urls.judge(df.limit(0)).count() == 0


def test_rules_are_found_by_their_rarest_token(spark, monkeypatch):
    pages = spark.createDataFrame([(f"http://h{k}.example.com/a/b{k % 2}",) for k in range(20)], "url string")
    rules = [urls.prefix_rule("block", "h3.example.com", "/a/b1"), urls.prefix_rule("block", "example.com", ""), urls.Rule("allow", "b0$", (), 99, "any")]
    places = pages.select(urls.tokens_of(urls.host_of("url"), urls.path_of("url")).alias("tokens"))
    assert {r.rule_id: r.token for r in urls.index(places, rules).collect()} == {0: "h:h3", 1: "h:example", 2: ""}
    small = sorted(map(tuple, urls.judge(pages, rules).collect()))
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, urls.judge(pages, rules).collect())) == small
    assert {r[3] for r in small} == {"any", "example.com"} | {"h3.example.com/a/b1"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, data, duck, name):
    assert compare(registry.QUERIES[name](spark, data), duck.sql(registry.ORACLES[name])) > 0


def test_pipeline_stages(spark, data):
    """Each stage against plain Python on what the one before it kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.store(stage(spark, docs, "/root/testdata/sf0.01"), "stage")
        rows[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == names
        ids = {r.doc_id for r in rows[name]}
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
            assert {i for i, q in labels.items() if q == 1} <= ids
            assert len({i for i, q in labels.items() if q == 0} & ids) <= 3
        elif name == "near-duplicates":
            plain = near([(r.doc_id, r.text) for r in before], corpus_pipeline.WORDS)
            assert ids == {i for i, *_, kept in plain if kept}
            assert {r.text for r in rows[name]} <= {r.text for r in before}
        elif name == "repeated passages":
            texts = {r.doc_id: r.text for r in before}
            for i, _, gone, kept in removed(list(texts.items())):
                own = next(r for r in rows[name] if r.doc_id == i)
                assert own.text == (kept if gone else texts[i]) and own.n_chars == len(own.text)
        else:
            assert ids == {r.doc_id for r in before}


def test_pipeline_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and {len(r) for r in rows} == {7}
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert max(ends.values()) <= 4096


def test_pipeline_of_nothing(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
