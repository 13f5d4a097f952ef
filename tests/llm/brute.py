"""Plain re-statements of what the operators must return; quadratic or slow, for small tables only."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

SEP = "\x20\x09-\x0D"
WORD = re.compile(f"[^{SEP}]+")


def words(text):
    return WORD.findall(text or "")


def lower_ascii(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def pii_base(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p, ok: [m.span() for m in re.finditer(p, text) if ok(m.group())]
    return {
        "email": find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": find(r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": find(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)}


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in sorted(v))


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def quality_base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    inside = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup,
            "n_repeat_words": len(inside), "base_failed": len(w) < 20 or 100 * len(inside) > 30 * len(w)}


PHRASES = ["all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum",
           "click here", "sign up for our newsletter", "subscribe to our newsletter", "licensed under the", "is licensed under", "released under the"]


def line_fails(line):
    """Verdict of the line rules on a line that holds a word."""
    w = words(line)
    symbols, bars = sum(c in "#*$%&|<>" for c in line), line.count("|") + line.count(">")
    upper, lower = sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
    closes = w[-1][-1] in ".!?;:\"')]}>\u2026\u201d\u2019\u00bb\u3002\uff01\uff1f\u061f\u0964"
    return (symbols > 0.5 * len(w) or upper > lower and 2 * line.count("!") >= len(w) > 1 or not closes and len(w) < 4
            or bars >= 3 and 4 * bars >= len(w) or len(w) <= 40 and any(p in lower_ascii(line) for p in PHRASES))


def line_verdict(text):
    """(kept, lines, failing lines) of a text."""
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    lost = [x for x in lines if line_fails(x)]
    kept = not quality_base(text)["base_failed"] and sum(map(len, lost)) <= 0.5 * sum(map(len, lines))
    return kept, len(lines), len(lost)


def shingles(text):
    w = words(lower_ascii(text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def jaccard(rows):
    """rows: (doc_id, text) -> {row number: (doc_id, size, component)}."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= 80 * len(sets[i] | sets[j]):
            top[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [(d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def exact_kept(rows):
    """Texts that stay after exact copies went, as a set of (doc_id, text)."""
    return {(d, t) for (d, t), x in zip(rows, exact(rows)) if x[3] or x[1] is None}


def near_kept(rows):
    """Rows that stay after near copies went, as a set of (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= 80 * len(sets[i] | sets[j]):
            top[root(i)] = root(j)
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, sha(rows[i][1] or ""))
    first = {}
    for i in range(len(rows)):
        if sets[i]:
            first[root(i)] = min(first.get(root(i), i), i, key=order)
    return {rows[i] for i in range(len(rows)) if not sets[i] or order(first[root(i)]) == order(i)}


def repeats(rows, length):
    count = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    keep = {t: max((x for x in v if x is not None), default=None) for t, v in groups.items()}
    return [(d, keep[t or ""], len(groups[t or ""]), d == keep[t or ""], sha(t or "")) for d, t in rows]


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    hits = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    hits += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    hits += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(hits)


def trie(rows):
    """rows: (conv_id, turn, role, text) -> set of node rows as the conversation trie lists them."""
    own = defaultdict(list)
    for c, n, r, t in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, r or "", t or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + v[h:])
        for d in range(len(seq) + 1):
            nodes[seq[:d]].add(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) or 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return {(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p])))))
            for p, m in nodes.items()}


def nearest_centroids(rows, k=8, rounds=10, seed=3):
    """rows: (vec_id, vector) -> list of (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    import math

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((sha(f"{seed}:{i}") if i is not None else "~", v) for i, v in kept)
    cents = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    done = assign()
    per = Counter()
    for d, j in done:
        per[j] += d
    return [(i, j, d, per[j], sum(per.values()), sha(",".join(map(str, cents[j])))) for (i, _), (d, j) in zip(kept, done)]


def best_products(rows, k=20, every=20):
    """rows: (vec_id, vector) -> list of (query_id, rank, vec_id, score)."""
    import math

    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(kept) if b != a)[:k]
            out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(found)]
    return out
