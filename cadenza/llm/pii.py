"""Personal data in whole texts, disguised or not, with spans in source code points.

A text is read twice. The plain pass applies the fixed patterns. The second pass rewrites the text with two transducers:
characters first (homoglyphs, digits of other scripts, invisible characters), then words (spelled digits, at and dot
disguises). Each keeps, for every character it writes, the source range that it stands for. The same patterns run over
the rewritten text; a hit that covers something rewritten is mapped back and added unless it overlaps a plain hit of its
kind. Texts without a trigger skip the second pass, and triggers are found by Arrow's regex engine on whole batches.

Without brackets a mail address counts as disguised only where both the at and the dots are spelled and its ending is a
known one or two letters that are no short word; ``at`` before a real dot is left alone, as prose says "look at example.com".

A null text is empty; an empty table gives an empty result. Repeated rows are judged one by one, null ids are kept, and other
columns are not looked at. Every pattern works in time linear in the text, however long its runs are.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrow_text import slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip(
    "АВЕКМНОРСТУХавеорсухіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορ",
    "ABEKMHOPCTYXabeopcyxijsdqwhABEZHIKMNOPTYXaivop"))
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits spelled in the languages of the corpus.
SPELLED = {w: str(d) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())}
# Without brackets, "at ... dot ..." is a disguise before one of these endings,
ENDINGS = "com|org|net|edu|gov|mil|info|biz|io|co|uk|de|fr|es|eu|us|ca|au|ch|nl|it|ru|jp|cn|br|mx|dev|app|xyz|online|site|tech|cloud|shop|blog"
# and before any other two letters that are no short word of the corpus' languages.
SHORT_WORDS = "a[lmnst]|b[ey]|d[aou]|e[nrstu]|g[o]|h[aei]|i[fhlmns]|j[ae]|l[aeo]|m[aeiy]|n[eio]|o[fhnrux]|s[aiou]|t[aeou]|u[mnp]|w[eo]|y[ao]|z[u]"
ANY_ENDING = rf"(?:{ENDINGS}|(?!(?:{SHORT_WORDS})(?![A-Za-z]))[a-z]{{2}})"
AT_WORDS, DOT_WORDS = "at|arobase|arroba", "dot|punkt|point|punto"

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a digit run that a match from its start would also reach.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Batch filters in RE2 syntax; each is implied by a match of its kind.
NEEDS = {"email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9]([ -]?[0-9]){12}", "phone": r"\+[0-9]"}
_SEP = r"[\s_]+"
TRIGGER = ("[" + "".join(HOMOGLYPHS) + INVISIBLE + r"\x{ff01}-\x{ff5e}\x{1d400}-\x{1d7ff}]|[^\P{Nd}0-9]|&#|&commat;|&period;"
           r"|(?i:[\[({<]\s*(" + AT_WORDS + "|" + DOT_WORDS + r")\s*[\])}>])|(?i:[\s_](" + DOT_WORDS + r")[\s_])|[A-Za-z0-9]\s+@\s*[A-Za-z0-9]|[A-Za-z0-9]\s*@\s+[A-Za-z0-9]"
           r"|(?i:\b(" + "|".join(SPELLED) + r")[\s,.-]+(" + "|".join(SPELLED) + r")\b)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run before an @ sign; walking back from the sign avoids retrying every start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


# ---------------------------------------------------------------- transducers

class Tape:
    """A rewritten text: character i stands for source[lo[i]:hi[i]]; changed[i] counts rewritten characters before i."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.new = [False] * len(text)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ranges of the current text; ranges are in order and apart. An empty replacement removes."""
        if not edits:
            return
        text, lo, hi, new, at = [], [], [], [], 0
        for start, end, put in edits:
            text += (self.text[at:start], put)
            lo += self.lo[at:start]
            hi += self.hi[at:start]
            new += self.new[at:start]
            lo += [self.lo[start]] * len(put)
            hi += [self.hi[end - 1]] * len(put)
            new += [True] * len(put)
            if not put and new:
                new[-1] = True          # something was removed right after this character
            at = end
        self.text = "".join(text) + self.text[at:]
        self.lo, self.hi, self.new = lo + self.lo[at:], hi + self.hi[at:], new + self.new[at:]


def plain_character(c: str) -> str:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in INVISIBLE:
        return ""
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.decimal(c))
    if "\uff01" <= c <= "\uff5e" or "\U0001d400" <= c <= "\U0001d7ff":
        put = unicodedata.normalize("NFKC", c)
        return put if len(put) == 1 and put.isascii() else c
    return c


_ENTITY = re.compile(r"&#0*64;|&#x0*40;|&commat;|&#0*46;|&#x0*2e;|&period;", re.I)
_BRACKET = re.compile(r"\s?\s?[\[({<]\s?(?:(" + AT_WORDS + r")|" + DOT_WORDS + r"|@|\.)\s?[\])}>]\s?\s?", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s{0,3}@\s{0,3}(?=[A-Za-z0-9])")
_BARE_AT_DOT = re.compile(r"(?<=[A-Za-z0-9])[\s_]{1,3}(?:" + AT_WORDS + r")[\s_]{1,3}(?=[A-Za-z0-9-]{1,63}(?:[\s_]{1,3}(?:" + DOT_WORDS + r")[\s_]{1,3}[A-Za-z0-9-]{1,63}){0,3}"
                          r"[\s_]{1,3}(?:" + DOT_WORDS + r")[\s_]{1,3}" + ANY_ENDING + r"(?![A-Za-z0-9]))", re.I)
_BARE_DOT = re.compile(r"[\s_]{1,3}(?:" + DOT_WORDS + r")[\s_]{1,3}(?=[A-Za-z0-9])|\s{1,2}\.\s{0,2}(?=[A-Za-z0-9])|\.\s{1,2}(?=(?:" + ENDINGS + r")\b)", re.I)
_LABELS_LEFT = re.compile(r"[A-Za-z0-9_%+-]{1,64}\Z")
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_ITEM = r"(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r"|[0-9]+)"
_RUN = re.compile(r"(?<![\w])(?:(?:plus|\+)[\s-]{0,2})?" + _ITEM + r"(?:(?:[\s,.()-]{1,3}(?:(?:" + DOT_WORDS + r"|dash|hyphen|minus)[\s-]{1,2})?)" + _ITEM + r"){2,}(?!\w)", re.I)
_RUN_PART = re.compile(r"\s*\b(" + DOT_WORDS + r")\b\s*|\s*\b(dash|hyphen|minus)\b\s*|\b(plus)\b[\s-]*|\b(" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")\b", re.I)


def _spelled_runs(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _RUN.finditer(text):
        parts, words = [], 0
        for p in _RUN_PART.finditer(text, m.start(), m.end()):
            dot, dash, plus, word = p.groups()
            if word:
                # One space or comma between two spelled digits goes with the second.
                start = p.start()
                if parts and parts[-1][2].isdigit() and not text[parts[-1][1]:start].strip(" ,-"):
                    start = parts[-1][1]
                parts.append((start, p.end(), SPELLED[word.lower()]))
                words += 1
            else:
                parts.append((p.start(), p.end(), "." if dot else "-" if dash else "+"))
        if words >= 3 or words and sum(c.isdigit() for c in m.group()) + words >= 9:
            edits += parts
    return edits


def _mail_disguises(tape: Tape) -> None:
    tape.edit([(m.start(), m.end(), "@" if "64" in m.group() or "40" in m.group() or "comm" in m.group().lower() else ".") for m in _ENTITY.finditer(tape.text)])
    tape.edit([(m.start(), m.end(), "@" if m.group(1) or "@" in m.group() else ".") for m in _BRACKET.finditer(tape.text)])
    tape.edit([(m.start(), m.end(), "@") for m in _BARE_AT_DOT.finditer(tape.text)])
    tape.edit([(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(tape.text) if m.end() - m.start() > 1])
    # Dots are spelled only next to an @ sign: labels to its right, names to its left.
    edits, text, done = [], tape.text, 0
    at = text.find("@")
    while at >= 0:
        left, i = [], at
        while True:
            m = _LABELS_LEFT.search(text, max(done, i - 64), i)
            if not m:
                break
            dots = list(re.finditer(r"[\s_]{1,3}(?:" + DOT_WORDS + r")[\s_]{1,3}\Z", text[max(done, m.start() - 16):m.start()], re.I))
            if not dots:
                break
            base = max(done, m.start() - 16)
            left.append((base + dots[-1].start(), m.start(), "."))
            i = base + dots[-1].start()
        edits += reversed(left)
        i = at + 1
        while True:
            m = _LABEL.match(text, i)
            if not m:
                break
            d = _BARE_DOT.match(text, m.end())
            if d:
                edits.append((d.start(), d.end(), "."))
                i = d.end()
            elif text[m.end():m.end() + 1] == ".":
                i = m.end() + 1
            else:
                i = m.end()
                break
        done = max(at + 1, i)
        at = text.find("@", done)
    tape.edit(edits)


def rewrite(text: str) -> Tape:
    tape = Tape(text)
    if not text.isascii():
        tape.edit([(i, i + 1, p) for i, c in enumerate(text) if c > "\x7f" and (p := plain_character(c)) != c])
    _mail_disguises(tape)
    tape.edit(_spelled_runs(tape.text))
    return tape


def disguised(text: str, plain: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows."""
    tape = rewrite(text)
    if not any(tape.new):
        return {}
    found: dict[str, list[tuple[int, int]]] = {}
    for kind, finder in FINDERS.items():
        taken, done = plain[kind], 0            # plain hits in order; later hits of the tape lie further right in the source
        for a, b in finder(tape.text):
            if any(tape.new[a:b]):
                start, end = tape.lo[a], max(tape.hi[a:b])
                i = bisect.bisect_left(taken, (start, start))
                apart = (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0])
                if apart and start >= done:
                    found.setdefault(kind, []).append((start, end))
                    done = end
    return found


# ---------------------------------------------------------------- Spark side

SCHEMA = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string, n_added long"


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, [])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of plain hits per kind, base_spans (plain), spans (all) as kind:start:end, and n_added."""

    def run(batches):
        for b in slices(batches, 1):
            col = b.column(1).fill_null("")
            may = {k: pc.match_substring_regex(col, NEEDS[k]).to_pylist() for k in KINDS}
            odd = pc.match_substring_regex(col, TRIGGER).to_pylist()
            rows = []
            for i in range(len(col)):
                base = {k: [] for k in KINDS}
                if odd[i] or any(may[k][i] for k in KINDS):
                    text = col[i].as_py()
                    for k in KINDS:
                        if may[k][i]:
                            base[k] = FINDERS[k](text)
                    more = disguised(text, base) if odd[i] else {}
                    every = {k: base[k] + more.get(k, []) for k in KINDS}
                    rows.append([*(len(base[k]) for k in KINDS), listed(base), listed(every), sum(map(len, more.values()))])
                else:
                    rows.append([0, 0, 0, 0, "", "", 0])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
