"""Packing, token files, URL aliases, mixing, components and the pipeline."""

import random

import brute
import numpy as np
import pytest
from conftest import SF, odd_texts
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import components, mixing, packing, token_file, tokens, url_filter
from cadenza.llm import queries as Q

WORD_FILE, BYTE_FILE = Q.tokenizer_path("word_bpe_49k.json"), Q.tokenizer_path("byte_bpe_50k.json")


def plain_ids(path, text):
    from tokenizers import Tokenizer

    known = plain_ids.__dict__
    if path not in known:
        known[path] = Tokenizer.from_file(path)
    t = known[path]
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD_FILE, BYTE_FILE])
def test_word_cache_equals_whole_texts(sample, path):
    import pyarrow as pa

    r = random.Random(3)
    odd = ["".join(r.choice(" \n\t\r\x0b\x0c\x85\xa0 　aA'sé́漢😀ß1,.#Σ\x1c") for _ in range(r.randrange(60))) for _ in range(400)]
    texts = [t for _, t in odd_texts()[:-4]] + odd + [t for _, t in sample[:60]] + ["<|endoftext|> it's I'll  two   three ", "a <|endoftext|> b", "a<|endoftext|>b <|startoftext|>\n<|endoftext|>"]
    e = tokens.Encoder(path, cache_words=50)
    assert e.by_words
    for _ in range(2):
        ids, n = e.encode(pa.array(texts, pa.string()))
        parts = np.split(ids, np.cumsum(n)[:-1])
        assert [p.tolist() for p in parts] == [plain_ids(path, t) for t in texts]


def test_packing(sample, documents):
    rows = sample[:60] + odd_texts()[:12] + [(70, "a <|endoftext|> b <|startoftext|>c")]
    got = packing.pack(documents(rows), WORD_FILE, 1).collect()
    at = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0) and 0 < p["length"] <= 2048
        at[p["sequence_id"]] = p["offset"] + p["length"]
    assert sorted(at) == list(range(len(at))) and all(at[s] == 2048 for s in sorted(at)[:-1])
    left = [(d, plain_ids(WORD_FILE, t) + [1]) for d, t in rows]
    ids_of = lambda p: np.frombuffer(p["ids"], "<u4").tolist()
    docs, now = [], None
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert brute.crc(ids_of(p)) == p["ids_crc32"]
        if p["start"] == 0:
            now = []
            docs.append((p["doc_id"], p["doc_tokens"], now))
        assert len(now) == p["start"]
        now.extend(ids_of(p))
    assert sorted(map(str, docs)) == sorted(str((d, len(i), i)) for d, i in left)
    seq = packing.sequences(packing.pack(documents(rows), WORD_FILE, 1))
    assert seq.filter("padding < 0 OR padding >= 2048").count() == 0
    assert packing.pack(documents(rows).limit(0), WORD_FILE, 1).count() == 0


def test_token_file(spark, sample, documents, tmp_path):
    rows = sample[:80] + odd_texts()[:12] + [(70, "a <|endoftext|> b<|endoftext|>")]
    path = str(tmp_path / "file")
    token_file.write_token_file(documents(rows), path, BYTE_FILE, 0, shard_rows=20, segment_tokens=5000)
    assert spark.read.parquet(path).count() > 5
    got = sorted(token_file.read_token_file(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(plain_ids(BYTE_FILE, t) + [0])
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    start = 0
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        want[r["doc_id"]].remove(ids)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert not any(want.values())
    empty = str(tmp_path / "empty")
    token_file.write_token_file(documents(rows).limit(0), empty, BYTE_FILE, 0)
    assert token_file.read_token_file(spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 511, 512, 513, 262144, 300000])
def test_coder_round_trip_checkpoints_and_damage(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 50000).astype(np.uint32)
    symbols, freq, bits = token_file.frequency_table(ids)
    assert int(freq.sum()) == 1 << bits and freq.min() >= 1
    blocks = token_file.encode_blocks(ids, symbols, freq, bits)
    table = token_file.Table(symbols.tobytes(), freq.tobytes())
    back = np.concatenate([token_file.decode_block(table, b) for b in blocks])
    assert (back == ids).all()
    first = blocks[0]
    for k, step in enumerate(first["checkpoint_steps"]):
        part = token_file.decode_block(table, first, checkpoint=k)
        assert (part == ids[:first["n_tokens"]][step * token_file.LANES:]).all()
    if n > 1000:
        assert sum(len(b["payload"]) for b in blocks) < 2 * n
        damaged = dict(first, payload=bytes([first["payload"][0] ^ 1]) + first["payload"][1:])
        with pytest.raises(ValueError):
            token_file.decode_block(table, damaged)


RULES = Q.URL_RULES


def verdicts(spark, pages, links=None, rules=RULES):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("x")).withColumn("node", F.lit(1))
    edges = spark.createDataFrame(links, "a string, b string") if links is not None else None
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules, links=edges).collect()}


@pytest.mark.parametrize("many", [False, True])
def test_url_aliases(spark, many):
    canon = lambda u: f'<html><link rel="canonical" href="{u}"></html>'
    pages = [(1, "http://a.org/x#t", canon("http://bad.net/1")), (2, "http://b.org/y", canon("/z?q=1&amp;r=2")), (3, "HTTP://WWW.Example.NET/en/1?q", None),
             (4, "http://c.org/1", '<meta http-equiv="refresh" content="0; url=http://b.org/z?q=1&r=2">'), (5, None, None), (6, "no scheme", canon("http://bad.net/")),
             (7, "http://d.org/fr/1", canon("http://bad.net/2")), (8, "http://e.org/q", "<link href='http://d.org/fr/1' rel=canonical>"), (9, "http://net", ""), (10, "http://x.net?/en/", ""),
             (11, "http://example.com/de/a", ""), (12, "http://example.com/dea", ""), (12, "http://example.com/dea", "")]
    extra = [(f"none{i}.example/", "block") for i in range(url_filter.LITERAL_RULES)] if many else []
    v = verdicts(spark, pages, [("http://c.org/1", "http://e9.net/#f"), (None, "x")], (*RULES, *extra))
    assert v[1] == ("a.org", "/x", None, "block") and v[3] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert v[2][3] == v[4][3] == "block" and v[5] == ("", "", None, "allow") and v[6] == ("", "", None, "allow")
    assert v[7] == ("d.org", "/fr/1", "org/fr/", "allow") and v[8][3] == "allow"          # an explicit allow precedes the block
    assert v[9] == ("net", "", None, "allow") and v[10][:3] == ("x.net", "", None)
    assert v[11][2:] == ("example.com/de/", "block") and v[12][2:] == (None, "allow")
    assert verdicts(spark, []) == {}


LINKED = [
    ("http://s.example/dir/page?x=1", '<meta content="0; URL=http://bad.net/1" http-equiv="Refresh">', "http://bad.net/1"),
    ("http://s.example/dir/page?x=1", '<META HTTP-EQUIV=refresh CONTENT=5;url=other.html>', "http://s.example/dir/other.html"),
    ("http://s.example/dir/page?x=1", "<link rel='canonical' href='?id=3&amp;y=2#top'/>", "http://s.example/dir/page?id=3&y=2"),
    ("HTTP://S.Example/dir/page", '<link href="../up/./A.html" rel="canonical">', "http://s.example/up/A.html"),
    ("http://s.example/dir/page", '<link rel=canonical href=/../../a/..>', "http://s.example/"),
    ("http://s.example/a/b/", '<link rel="canonical" href="..">', "http://s.example/a/"),
    ("http://s.example", '<link rel="canonical" href="x?y">', "http://s.example/x?y"),
    ("https://s.example/p", '<link rel="canonical" href="//O.Example/Q">', "https://o.example/Q"),
    ("http://s.example/p", '<link rel="canonical" href="HTTPS://O.Example/Q?u=http://x/">', "https://o.example/Q?u=http://x/"),
    ("http://s.example/p", '<link rel="canonical" href="mailto:a@b.c"><link rel="canonical" href="#x"><link rel="canonical" href="">', None),
    ("http://s.example/p", '<link rel="stylesheet" href="/c.css"><meta name="x" content="url=/d"><a href="/e">', None),
]


def test_page_links(spark):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(LINKED)]
    got = url_filter.page_links(spark.createDataFrame(rows, "page_id long, url string, html string"))
    lower = lambda u: u.replace("HTTP://S.Example", "http://s.example")
    assert sorted(map(tuple, got.collect())) == sorted((lower(u), t) for u, _, t in LINKED if t)
    two = spark.createDataFrame([(1, "http://a.example/", LINKED[0][1] + '<link rel="canonical" href="b"> x <link href="c" rel="canonical">')], "page_id long, url string, html string")
    assert {r["b"] for r in url_filter.page_links(two).collect()} == {"http://bad.net/1", "http://a.example/b", "http://a.example/c"}


def test_linked_pages_match_sql(spark, tmp_path):
    """Links of every kind planted into a table of pages, against the SQL of op4_url_aliases."""
    import duckdb
    from check_queries import table_rows

    r = random.Random(4)
    hosts = ["a.example", "B.Example", "c.org", "example.net", "x.net"]
    paths = ["/", "", "/fr/1", "/en/2?q=1", "/de/../fr/x", "/a/b/c.html"]
    url = lambda: "http://" + r.choice(hosts) + r.choice(paths) + r.choice(["", "#f"])
    ref = lambda: r.choice([url(), "z.html", "../fr/y", "?k=2", "/en/3", "//c.org/fr/9", "mailto:x@y", "./", "..", "#s"])
    tag = lambda: r.choice(['<link rel="canonical" href="{}">', "<link href='{}' rel='canonical'>", '<meta http-equiv="refresh" content="1; url={}">',
                            '<META content="0;URL={}" http-equiv=refresh />', '<link rel="icon" href="{}">']).format(ref())
    pages = [(i, url(), " text ".join(tag() for _ in range(r.randrange(0, 3)))) for i in range(60)] + [(100, None, tag()), (101, "none", None), (101, "none", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = Q.op4_url_aliases(spark, str(tmp_path))
    cur = con.execute(Q.ORACLES["op4_url_aliases"])
    assert table_rows(df.columns, df.collect()) == table_rows([c[0] for c in cur.description], cur.fetchall())


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(280)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 300)] + [(None, 3), (7, 7)]
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {row["node"]: row["component"] for row in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def spread(budget, children):
    """Brute water filling: children (name, weight, cap)."""
    open_ = [c for c in children if c[1] > 0 and c[2] > 0]
    got, budget = {}, min(budget, sum(c[2] for c in open_))
    while True:
        total = sum(c[1] for c in open_)
        full = [c for c in open_ if c[2] * total <= c[1] * budget]
        if not full:
            break
        for c in full:
            got[c[0]] = c[2]
            budget -= c[2]
        open_ = [c for c in open_ if c not in full]
    total = sum(c[1] for c in open_)
    for c in open_:
        got[c[0]] = c[1] * budget // total
    for c in sorted(open_)[:budget - sum(got[c[0]] for c in open_)]:
        got[c[0]] += 1
    return got


@pytest.mark.parametrize("seed", range(3))
def test_shares(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for p in range(20):
        children = [(f"{p}/{i}", r.randrange(0, 6), r.choice([0, 3, 50, 1000, 10**15])) for i in range(r.randrange(1, 7))]
        budget = r.randrange(0, 4000)
        rows += [(str(p), *c, budget) for c in children]
        want |= spread(budget, children)
    df = spark.createDataFrame(rows, "parent string, node string, weight long, cap long, budget long")
    got = {x["node"]: x["tokens"] for x in mixing.share(df.select("parent", "node", *(F.col(c).cast(mixing.D).alias(c) for c in ("weight", "cap", "budget")))).collect()}
    assert got == want


def test_mixing(spark, documents):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 50))) for i in range(3000)] + odd_texts()[:9]
    docs = documents(rows)
    n = {}
    for d, t in rows:
        n.setdefault(d, []).append(len(brute.words(t)))
    total = sum(sum(v) for v in n.values())
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    one = lambda **k: mixing.mix(docs, levels, mixing.word_count(F.col("text")), {("en",): 3, ("fr",): 0, (None,): 1}, 5, **k)
    out = one(epochs=2, budget_tokens=30_000).collect()
    by = {}
    for r in out:
        by.setdefault((r["lang"], r["source"]), []).append(r)
    assert sum(r["_tokens"] for r in out) <= 30_000 and "fr" not in {k[0] for k in by} and (None, None) in by
    assert sum(r["_tokens"] for r in out) > 30_000 - 8 * 60 and docs.columns == [c for c in one(epochs=2, budget_tokens=9).columns if c not in ("_epoch", "_tokens")]
    en = sum(r["_tokens"] for r in out if r["lang"] == "en")
    assert abs(en - 22_500) <= 4 * 60
    assert sorted(str(x) for x in one(epochs=2, budget_tokens=30_000).collect()) == sorted(map(str, out))
    everything = mixing.mix(docs, levels, mixing.word_count(F.col("text")), {}, 5, epochs=3, budget_tokens=10**12).collect()
    assert sum(r["_tokens"] for r in everything) == 3 * total
    assert mixing.mix(docs.limit(0), levels, mixing.word_count(F.col("text")), {}, 5).count() == 0


@pytest.mark.parametrize("key", sorted(Q.ORACLES))
def test_queries_match_sql(spark, key):
    import duckdb
    from check_queries import TABLES, table_rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.QUERIES[key](spark, SF)
    cur = con.execute(Q.ORACLES[key])
    assert table_rows(df.columns, df.collect()) == table_rows([c[0] for c in cur.description], cur.fetchall())


def test_pipeline_stages(spark, documents, sample):
    """Each stage against brute force on its own input; odd rows pass through all of them."""
    docs = documents(sample + odd_texts())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = out.persist()
            got = [(r["doc_id"], r["text"]) for r in out.collect()]
        if name == "quality_rules":
            assert {d for d, _ in got} <= {d for d, t in rows if not brute.quality_base(t)["base_failed"]}
            assert len(got) > 0.7 * len(sample)
        elif name == "exact_dedup":
            assert sorted(map(str, got)) == sorted(map(str, brute.exact_kept(rows)))
        elif name == "ngram_jaccard_join":
            assert sorted(map(str, got)) == sorted(map(str, brute.near_kept(rows)))
        elif name == "mixing":
            assert set(got) <= set(rows) and 0 < sum(len(brute.words(t)) for _, t in got) <= sum(len(brute.words(t)) for _, t in rows) * 3 // 4
        else:
            assert out.agg(F.sum("length")).first()[0] == sum(len(plain_ids(WORD_FILE, t)) + 1 for _, t in rows)
            break
        docs, rows = out, got
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
