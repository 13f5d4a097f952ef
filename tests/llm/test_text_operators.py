"""PII, line rules, near and exact copies, repeats and secrets against brute force."""

import brute
import pytest
from conftest import odd_texts

from cadenza.llm import exact_dedup, jaccard_join, line_rules, pii, repeats, secrets

key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
same = lambda got, want: sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("odd", [False, True])
def test_pii_base(sample, documents, odd):
    rows = odd_texts() + [(30, "a@b.co a@b.co1.2.3.4.5 300.1.1.1 +1 (555) 123-4567 4111 1111-1111 1111 x@@y.z +1+2345678901 1.2.3")] if odd else sample
    got = pii.find_pii(documents(rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans").collect()
    want = [(d, *(len(v) for v in b.values()), brute.listed(b)) for d, t in rows for b in [brute.pii_base(t)]]
    assert same(got, want)


@pytest.mark.parametrize("text,hit", [
    ("write to jane.doe [at] mail (dot) example [dot] org now", "email:jane.doe [at] mail (dot) example [dot] org"),
    ("write to jane dot doe at example dot org now", "email:jane dot doe at example dot org"),
    ("ask jane at firma dot pl please", "email:jane at firma dot pl"),
    ("ask jane_at_shop_dot_firma_dot_se please", "email:jane_at_shop_dot_firma_dot_se"),
    ("ask jane arobase firma point dev or", "email:jane arobase firma point dev"),
    ("ask jane at firma dot up or dot in between", "none"),
    ("mail jane@example​.org ok", "email:jane@example​.org"),
    ("mail jаne@exаmple.org ok", "email:jаne@exаmple.org"),
    ("jane @ example.org", "email:jane @ example.org"),
    ("jane&#64;example.org", "email:jane&#64;example.org"),
    ("call +1 five five five one two three four five six seven today", "phone:+1 five five five one two three four five six seven"),
    ("call +１ ５５５ 123 4567 today", "phone:+１ ５５５ 123 4567"),
    ("card four one one one one one one one one one one one one one one one end", "card:four one one one one one one one one one one one one one one one"),
    ("host 192 dot 168 dot one dot seven up one two", None),                   # one dash too few: too short a run of spelled digits
    ("host one nine two dot one six eight dot one dot seven up", "ip:one nine two dot one six eight dot one dot seven"),
])
def test_pii_disguises(documents, text, hit):
    r = pii.find_pii(documents([(1, text)])).first()
    found = [f"{k}:{text[int(a):int(b)]}" for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
    assert found == [] if hit == "none" else hit in found if hit else not any(f.startswith("ip:") for f in found)
    assert r["base_spans"] == brute.listed(brute.pii_base(text))


def test_pii_added_spans_by_plain_rules(documents):
    """Disguises planted into prose, and many of them in one text: every one is found at its place and nothing else."""
    import random
    import time

    r = random.Random(6)
    hide = [lambda u, h, e: f"{u} [at] {h} [dot] {e}", lambda u, h, e: f"{u} (at) {h}.{e}", lambda u, h, e: f"{u} at {h} dot {e}", lambda u, h, e: f"{u}&#64;{h}.{e}", lambda u, h, e: f"{u}\u200b@{h}.{e}"]
    filler = "the birds sang over the quiet river while nobody was looking and".split()

    def planted(n):
        out, spans = "", []
        for _ in range(n):
            out += " ".join(r.choice(filler) for _ in range(6)) + "; "
            mail = r.choice(hide)(f"user{r.randrange(99)}", f"host{r.randrange(99)}", r.choice(["org", "pl", "se", "dev"]))
            spans.append((len(out), len(out) + len(mail)))
            out += mail + "; "
        return out, spans

    texts = [planted(n) for n in (0, 1, 3, 10, 40)]
    got = {x["doc_id"]: (x["n_added"], x["spans"]) for x in pii.find_pii(documents(list(enumerate(t for t, _ in texts)))).collect()}
    assert got == {i: (len(s), brute.listed({"email": s})) for i, (_, s) in enumerate(texts)}
    cost = []
    for n in (1500, 6000):
        text, spans = planted(n)
        start = time.perf_counter()
        assert len(pii.disguised(text, {k: [] for k in pii.KINDS})["email"]) == n
        cost.append(time.perf_counter() - start)
    assert cost[1] < 10 * cost[0]                      # four times the hits; sixteen would be quadratic
    assert pii.find_pii(documents([(1, "a@b.co")]).limit(0)).count() == 0


def test_pii_leaves_prose_alone(documents):
    texts = ["Look at the dot on the map at noon.", "one two three go", "Meet at example. Dot com is a boom.", "a point at point zero", "null eins zwei",
             "It is at 5. Then at 6. un deux trois quatre cinq", "Тест на кириллице", "ΑΒΓ δε"]
    assert [r["spans"] for r in pii.find_pii(documents(list(enumerate(texts)))).collect()] == [""] * len(texts)


@pytest.mark.parametrize("odd", [False, True])
def test_quality_base(sample, documents, odd):
    rows = odd_texts() if odd else sample
    want = [(d, *brute.quality_base(t).values()) for d, t in rows]
    got = line_rules.line_quality(documents(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert same(got, want)


def test_line_rules(documents):
    prose = "The quick brown fox jumps over the lazy dog near the river bank at dawn while birds sing in every tree."
    menu = "Home | About | Contact | Shop | News | Login | Help | Terms | Press | Jobs"
    rows = [(1, prose), (2, f"{menu}\n{prose}"), (3, f"{menu}\n{menu} | More | Again\n{menu}| x\nShort text ends here."), (4, f"{prose}\nAll rights reserved."),
            (5, " ".join(f"word{i}$$$" for i in range(40))), (6, " ".join(f"SHOUT{'ABCDEFG'[i % 7]}{'HIJKLMN'[i // 7]}!!" for i in range(40))), (7, None)]
    out = {r["doc_id"]: r for r in line_rules.line_quality(documents(rows)).collect()}
    assert line_rules.line_quality(documents(rows + rows)).filter("kept").count() == 6             # repeated rows are judged alike
    assert {d: out[d]["kept"] for d in out} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}
    assert out[2]["clean_text"] == prose and out[4]["clean_text"] == prose + "\n" and out[1]["clean_text"] == prose
    kept = line_rules.keep_clean(documents(rows)).collect()
    assert {r["doc_id"]: r["n_chars"] for r in kept if r["n_chars"] is not None}[2] == len(prose)
    assert line_rules.keep_clean(documents(rows).limit(0)).count() == 0


def test_line_verdicts_against_plain_rules(sample, documents):
    import random

    r = random.Random(8)
    parts = ["Home | About | Shop", "> quoted > twice > thrice", "ALL CAPS NOW!! BUY!", "short", "ends well.", "drei Wörter hier »", "some longer line without any closing mark at all",
             "Click HERE to enable JavaScript today", "100 % ### *** $$$", "a normal sentence of several plain words that ends here.", "e\u0301t\u00e9 \u6f22\u5b57\u3002", "", "  \t ",
             "\u201cWhat now?\u201d", " ".join(["word"] * 45) + " all rights reserved", "x|y|z|w words more words and more", "line\x0bwith\x0cfeeds."]
    made = [(5000 + i, "\n".join(r.choice(parts) for _ in range(r.randrange(1, 14)))) for i in range(300)]
    rows = sample + odd_texts() + made
    got = line_rules.line_quality(documents(rows), with_text=False).select("doc_id", "kept", "n_lines", "n_failed_lines").collect()
    assert same(got, [(d, *brute.line_verdict(t)) for d, t in rows])
    assert 40 < sum(brute.line_verdict(t)[0] for _, t in made) < 260
    assert line_rules.line_quality(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [2048, 4])
def test_jaccard(sample, documents, block_rows):
    words = [f"t{i * 31 % 211}" for i in range(120)]
    near = [(1000 + k, " ".join(words[:k * 3] + [f"new{k}"] + words[k * 3 + 1:])) for k in range(30)]        # a large group of near copies
    chain = [(2000 + k, " ".join(f"c{i}" for i in range(k * 4, k * 4 + 60))) for k in range(12)]           # links without all pairs
    rows = sample + odd_texts() + near + chain
    got = jaccard_join.jaccard_components(documents(rows), block_rows=block_rows).collect()
    assert same(got, brute.jaccard(rows))


def test_jaccard_tasks_stay_bounded_in_a_loose_cluster(documents, monkeypatch):
    """Pages of frequent passages: one cluster, hardly a link, so nearly every row meets every other one."""
    import random

    r, most, block_rows = random.Random(1), [], 16
    passages = [" ".join(f"p{p}x{i}" for i in range(24)) for p in range(60)]
    rows = [(k, " ".join(r.sample(passages, 5))) for k in range(300)]
    rows += [(1000 + k, rows[k * 7][1] + f" tail{k} more words here") for k in range(20)]
    plain = jaccard_join._links

    def watched(blocks, *args):
        group = [c for c in ("cluster", "block", "against") if c in blocks.columns]
        most.append(max(x["count"] for x in blocks.groupBy(*group).count().collect()))
        return plain(blocks, *args)

    monkeypatch.setattr(jaccard_join, "_links", watched)
    got = jaccard_join.jaccard_components(documents(rows), block_rows=block_rows).collect()
    assert same(got, brute.jaccard(rows))
    assert len(most) > 1 and max(most) <= 2 * block_rows          # each of two blocks holds block_rows at most


def test_jaccard_keeps_one(documents):
    base = odd_texts()[3][1]
    lone = " ".join(f"z{i}" for i in range(90))
    # One id for two texts: one a near copy of another text, the other first of its own group; and near copies without an id.
    rows = odd_texts() + [(6, lone), (145, lone + " end"), (0, base + " x"), (None, lone.replace("z3 ", "y3 "))] + [(None, "n " * 9 + f"null {i} " + lone[::-1]) for i in range(3)]
    for twice in (rows, rows + rows):
        kept = jaccard_join.keep_one(documents(twice)).collect()
        assert same([(r["doc_id"], r["text"]) for r in kept], brute.near_kept(rows))
    assert jaccard_join.jaccard_components(documents(rows).limit(0)).count() == 0


def test_repeats_at_full_length(sample, documents):
    rows = sample[:80] + odd_texts()[:8]
    got = repeats.remove_repeats(documents(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert same(got, brute.repeats(rows, 400))


@pytest.mark.parametrize("hot", [4096, 2])
def test_repeats_in_dense_texts(spark, documents, hot):
    """Few symbols, many overlaps, repeats inside one text, passages just below and above the length."""
    import random

    r = random.Random(hot)
    passage = "".join(r.choice("abcdef ") for _ in range(900))
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randrange(0, 700)))) for i in range(30)]
    for i in range(60):
        a, n = r.randrange(0, 450), r.choice([398, 399, 400, 401, 403, 440])
        rows.append((100 + i, "".join(r.choice("xyzé") for _ in range(r.randrange(0, 300))) + passage[a:a + n] + "".join(r.choice("xyzé") for _ in range(r.randrange(0, 300)))))
    rows += [(200, "q" * 1300), (201, passage + passage), (202, None), (203, ""), (None, "k" * 399), (204, "m" * 400)]
    docs = documents(rows)
    spans = repeats.repeated_spans(docs, hot_core=hot)
    got = {}
    for s in spans.collect():
        got.setdefault(s["doc_id"], set()).update(range(s["start"], s["end"]))
    want = {d: n for d, _, n, _, _ in brute.repeats(rows, 400) if n}
    assert {d: len(v) for d, v in got.items()} == want


def test_repeats_of_nothing(documents):
    assert repeats.remove_repeats(documents(odd_texts()).limit(0)).count() == 0


def test_common_prefixes():
    import numpy as np

    r = np.random.default_rng(5)
    strings = [r.integers(0, 3, n) for n in (40, 40, 17, 1, 0, 60)]
    strings.append(strings[0])
    m = len(strings)
    s = np.concatenate([np.append(x + m, i) for i, x in enumerate(strings)])
    order = repeats.suffix_order(s)
    text = s.tolist()
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for limit in (1, 4, 100):
        want = [0] + [next((k for k in range(limit) if text[a + k] != text[b + k]), limit) for a, b in zip(order, order[1:])]
        assert repeats.bounded_prefixes(s, order, limit).tolist() == want


@pytest.mark.parametrize("odd", [False, True])
def test_exact_groups(sample, documents, odd):
    rows = odd_texts() + [(50, "a" * 9000), (51, "a" * 9001), (52, "a" * 9000)] if odd else sample
    assert same(exact_dedup.exact_groups(documents(rows)).collect(), brute.exact(rows))
    if odd:
        for twice in (rows, rows + rows):
            kept = exact_dedup.keep_last(documents(twice)).collect()
            assert same([(r["doc_id"], r["text"]) for r in kept], brute.exact_kept(rows))
        assert exact_dedup.exact_groups(documents(rows).limit(0)).count() == 0


def test_chunks_restore_the_text_and_collisions_fail(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(odd_texts())
    back = docs.select(F.coalesce("text", F.lit("")).alias("t"), F.array_join(exact_dedup.chunks_of(F.col("text")), "").alias("u"))
    assert back.filter("t <> u").count() == 0
    with pytest.raises(ValueError):
        exact_dedup.verify_chunks(docs, "text", digest=lambda c: F.substring(F.sha2(c, 256), 1, 1))


@pytest.mark.parametrize("odd", [False, True])
def test_secrets(spark, sample, documents, tmp_path, odd):
    tricky = ["password=secret:12345678 token = 'abcdefgh'", "api_key: short API-KEY=longenough1 apikey=\"A/b+c_d.e=f-g\"", "AKIAAKIA12345678 AKIA123", "deadbeef" * 4 + "G" + "0" * 31,
              "é" * 50 + "SeCrEt=ééé token=12345678é", "token=token=abcdefgh"]
    many = "é ".join(f"x token={i:09d} é y" for i in range(secrets.RUN * 2 + 7))                        # several runs of matches
    tricky += [many, "token=" + "a" * 9 + " ", " ".join(["token=12345678"] * secrets.RUN)]
    rows = odd_texts() + list(enumerate(tricky, 60)) if odd else sample
    got = secrets.scan_versions(documents(rows), str(tmp_path / "ledger")).collect()
    want = [(d, [(a, k, n, b) for a, k, n, b in brute.secrets(t)]) for d, t in rows]
    assert same([(r["path"], str([tuple(x) for x in r["found"]])) for r in got], [(d, str(v)) for d, v in want])


def test_secrets_scan_only_what_is_new(spark, documents, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = documents([(1, "token=abcdefgh1"), (2, "clean"), (3, None)])
    secrets.scan_versions(first, ledger).collect()
    pairs = lambda: spark.read.parquet(f"{ledger}/pairs").count()
    assert pairs() == 9
    secrets.scan_versions(first, ledger).collect()
    assert pairs() == 9
    again = secrets.scan_versions(documents([(9, "token=abcdefgh1"), (8, "new token=12345678")]), ledger)
    assert {r["path"]: len(r["found"]) for r in again.collect()} == {9: 1, 8: 1} and pairs() == 12
    newer = tuple(secrets.Rule(r.name, r.pattern, r.group, r.least, 2 if r.name == "hex" else 1, r.hint) for r in secrets.RULES)
    secrets.scan_versions(first, ledger, rules=newer).collect()
    assert pairs() == 15
    assert secrets.scan_versions(first.limit(0), ledger).count() == 0
