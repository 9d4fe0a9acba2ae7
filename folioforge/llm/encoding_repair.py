"""Text that was decoded with a wrong character encoding, and its repair.

A window (words with suspicious characters and their neighbours) is the start
of a best-first search.  Steps encode the text in a codec it may have been
wrongly decoded with and decode the bytes in the right one, or unescape
character references.  A state's cost is the implausibility of its characters
plus a charge for each step; states are visited once (by hash), the cheapest
first, and the cheapest one reached is the repair.  A window is a case if its
repair is clearly cheaper, or if it holds characters that only damage leaves
(replacement characters, C1 controls) even though nothing restores them.

Defined results: null html and null or empty headers give no row; a repeated
page gives each field once; texts of any length are scanned whole, in linear
time: a long run is searched in pieces of some ``PIECE`` characters, cut at
white space, and all pieces count.  Where single windows give too little evidence,
the gains of one step are summed over all windows of the field and the step is
charged once.  A repair replaces the damaged spans alone; markup, references
and header names stay as they are.
"""

from __future__ import annotations

import bisect
import heapq
import html as _html
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 400
#: States opened one after the other without a cheaper text before a search gives up; README says what more would change.
PATIENCE = 6
#: Share of a text's cost under which what strict steps reached needs no loose ones.
CLEAR = 0.4
#: A strict multi-byte decoding hardly succeeds by chance, a single-byte one always does.
STRICT_COST, LOOSE_COST = 0.1, 0.6
LEAST_GAIN = {True: 0.1, False: 0.55}

WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp850", "cp437", "koi8-r", "cp866", "iso8859-2", "cp1254", "mac_cyrillic")
RIGHT = ("cp1252", "cp1251", "koi8-r", "mac_roman", "cp850", "cp866", "cp1250")


def _tolerant(codec: str) -> tuple[dict[int, int], str]:
    """Maps from characters to bytes and back where undefined bytes are the control characters of that number."""
    back, there = [], {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        back.append(c)
    for b, c in enumerate(back):
        there.setdefault(ord(c), b)
    for b in range(0x80, 0xA0):
        there.setdefault(b, b)
    return there, "".join(back)


_TABLES = {c: _tolerant(c) for c in {*WRONG, *RIGHT}}

#: Percentages of letters in Russian text, in the order of the alphabet without yo.
_RU = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", (8.0, 1.6, 4.5, 1.7, 3.0, 8.5, 0.9, 1.7, 7.4, 1.2, 3.5, 4.4, 3.2, 6.7, 11.0, 2.8, 4.7, 5.5, 6.3, 2.6, 0.3, 1.0, 0.5, 1.4, 0.7, 0.4, 0.04, 1.9, 1.7, 0.3, 0.6, 2.0)))
_RU_COST = {c: max(0.0, math.log(8.0 / p)) * 0.22 for c, p in _RU.items()}
_RU_COST["ё"] = 0.25
#: Frequent pairs of letters in Russian text.
_RU_PAIRS = frozenset(
    "ст но то на ен ов ни ра во ко ро по пр ер ре ли го ос ол ал ла не он та те ан ка ва од от ат ет ть ин ом ор ес ти ло ве ел ри ем ки ил да де"
    " за ак ог об ль ск ит ле ис ми ма мо ас ар ой ый ая ие ия их ых ам ей ся со сь ту ди до жи же из ик им ку мы ну ны ня пе пи ру са се си су ты"
    " ус ут хо це ци ча че чи ша ше ши ют ят ед ев ег аз ыв ып вы вы ук ив бо бу ба бы ой ви во яя ий йк".split()
)

#: Letters of French, German, Spanish, Portuguese and Italian beside ASCII.
_COMMON_LATIN = frozenset("àâäãáçéèêëíîïñóôöõúùûüßœæÀÂÄÃÁÇÉÈÊËÍÎÏÑÓÔÖÕÚÙÛÜŒÆªº")
_COMMON_SIGNS = frozenset("«»„“”‘’–—…€·•©®→←›‹°±µ№§£¿¡\xa0™×½¼¾²³¹´¨¯¸¶¤¥¦¬ˆ˜‰†‡‚ƒ")
_OPENING = frozenset("«„“‘¿¡‹(")


_CACHE: dict[str, float] = {}


def _one(c: str) -> float:
    """Implausibility of one character by itself."""
    got = _CACHE.get(c)
    if got is not None:
        return got
    o = ord(c)
    kind = unicodedata.category(c)
    low = c.lower()
    if o < 0x80:
        cost = 0.0 if c.isprintable() or c in "\n\r\t" else 3.0
    elif c == "�":
        cost = 3.0
    elif o < 0xA0 or kind in ("Cn", "Co", "Cs"):
        cost = 3.0
    elif low in _RU_COST:
        cost = 0.06 + _RU_COST[low] * 0.5
    elif c in _COMMON_LATIN:
        cost = 0.3
    elif c in "–—’‘“”«»…·©€→›•„\xa0¿¡":
        cost = 0.25
    elif c in "°±µ№®™×£§":
        cost = 0.5
    elif kind == "Mn" or c == "\xad" or 0xFB00 <= o <= 0xFB06:
        cost = 1.0
    elif c in _COMMON_SIGNS:
        cost = 1.1
    elif kind[0] == "L":
        cost = 0.5 if o < 0x250 else 0.8 if 0x400 <= o < 0x460 else 0.4
    else:
        cost = 1.4
    _CACHE[c] = cost
    return cost


def _script(c: str) -> int:
    """1 Latin, 2 Cyrillic, 3 other letters, 0 none."""
    o = ord(c)
    if not c.isalpha():
        return 0
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return 1
    return 2 if 0x400 <= o < 0x530 else 3


_VOWELISH = frozenset("áàâäãéèêëíìîïóòôöõúùûüæœýÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÆŒÝ")


_INFO: dict[str, tuple[float, int, bool, bool, bool]] = {}


def _info(c: str) -> tuple[float, int, bool, bool, bool]:
    """(cost, script, is a letter, is upper, is lower) of a character."""
    got = _INFO[c] = (_one(c) if c >= "\x80" else 0.0, _script(c), c.isalpha(), c.isupper(), c.islower())
    return got


def implausibility(text: str, limit: float = math.inf) -> float:
    """Cost of a text; 0 for plain ASCII prose.  Beyond ``limit`` the rest is not counted."""
    cost, prev, prev_script, run, inside = 0.0, "", 0, 0, False
    known = _INFO
    prev_lower = prev_alpha = False
    for c in text:
        own, script, alpha, upper, lower = known.get(c) or _info(c)
        if not alpha and prev and prev in "¿¡":
            cost += 1.2  # an opening mark that opens nothing
        if inside and alpha and not prev_script and prev not in "’·–—-\xa0":
            cost += 0.9  # a sign between two letters
        inside = prev_script != 0 and c > "\x7f"
        if c < "\x80":
            s = 1 if alpha else 0
            if s:
                if prev_script == 2 and prev_alpha:
                    cost += 1.0
                elif prev > "\x7f":
                    if not prev_script and prev not in _OPENING and prev not in "–—’”»…→›•·\xa0©№€±":
                        cost += 0.8  # a sign stuck to a following letter
                    elif upper and prev_script == 1 and prev_lower:
                        cost += 0.5
            run = 0
            prev, prev_script, prev_lower, prev_alpha = c, s, lower, alpha
            continue
        if cost > limit:
            return cost
        cost += own
        s = script
        if s:
            if prev_script and s != prev_script:
                cost += 1.0
            elif prev_script and upper and prev_lower:
                cost += 1.6
            elif s == 2 and prev_script == 2 and (prev + c).lower() not in _RU_PAIRS:
                cost += 0.2
            elif s == 2 and not prev_script:
                cost += 0.15
            elif prev > "\x7f" and not prev_script and not prev.isspace() and prev not in _OPENING and prev not in "–—’”»…→›•·©№€±":
                cost += 0.6
            run = run + 1 if s == 1 else 0
            if run >= 3:
                cost += 0.5
        else:
            run = 0
            if prev_script and c not in "’‘–—…»”“«›→·\xa0™®°" and not c.isspace():
                cost += 0.8  # a sign stuck to a letter before it
            elif prev and prev in "ÂÃĂ├┬√":
                cost += 0.8
        prev, prev_script, prev_lower, prev_alpha = c, s, lower, alpha
    return cost


def steps(text: str) -> Iterator[tuple[str, bool]]:
    """Texts one decoding away, and whether the decoding could have failed; the strict ones first."""
    if "&" in text:
        plain = _html.unescape(text)
        if plain != text:
            yield plain, True
    left: dict[bytes, str] = {}
    for wrong in WRONG:
        there, _ = _TABLES[wrong]
        try:
            data = bytes([there[ord(c)] for c in text])
        except KeyError:
            continue
        if data in left:
            continue
        left[data] = wrong
        try:
            yield data.decode("utf-8"), True
        except UnicodeDecodeError:
            continue
        left[data] = ""
    for data, wrong in left.items():
        if wrong:
            for right in RIGHT:
                if right != wrong:
                    yield data.decode("latin-1").translate(_DECODE[right]), False


_DECODE = {c: {b: ch for b, ch in enumerate(back) if b >= 0x80} for c, (_, back) in _TABLES.items()}


def search(text: str) -> tuple[str, float, float, bool]:
    """(cheapest reachable text, its cost, cost of the text itself, whether every step to it was strict)."""
    base = implausibility(text)
    best, best_cost, best_strict = text, base, False
    heap: list[tuple[float, int, str, float, bool]] = [(base, 0, text, 0.0, True)]
    visited = {hash(text)}
    tick = idle = 0
    while heap and idle < PATIENCE:
        _, _, state, paid, strict = heapq.heappop(heap)
        if paid + STRICT_COST >= best_cost:  # no text can cost less than the steps to it
            continue
        idle += 1
        for nxt, sure in steps(state):
            if not sure and best_strict and best_cost < CLEAR * base:
                break  # a strict way is as good as found
            h = hash(nxt)
            if h in visited:
                continue
            visited.add(h)
            tick += 1
            spent = paid + (STRICT_COST if sure else LOOSE_COST)
            # a loose step that gains nothing is left
            c = implausibility(nxt, math.inf if sure else max(best_cost, base - 0.5) - spent) + spent
            if c < best_cost:
                best, best_cost, best_strict, idle = nxt, c, strict and sure, 0
            if sure or c < base - 0.5:
                heapq.heappush(heap, (c, tick, nxt, spent, strict and sure))
    return best, best_cost, base, best_strict


#: Bytes 80 to BF as the usual single-byte codecs show them.
_TAIL = "".join(sorted({chr(b) for b in range(0x80, 0xC0)} | {c for n in ("cp1252", "cp1250", "cp1251") for c in _TABLES[n][1][0x80:0xC0]} - {"\x85"}))
_TAIL = re.escape(_TAIL)
_MAC_TAIL = re.escape("".join(_TABLES["mac_roman"][1][0x80:0xC0]))
#: What makes a text worth a search.
SUSPECT = re.compile(
    "[�\x80-\x84\x86-\x9f]"
    f"|[Â-ÅÎ-ÑâðĂĹĎ][{_TAIL}]"
    f"|[РС][{_TAIL}Ѐ-џ][РС][{_TAIL}Ѐ-џ]"
    f"|[ВГЕв][{_TAIL}]"
    f"|[√¬][{_MAC_TAIL}]|‚Ä|–[∞-≥ΩΩ∂∏∫π∑]"
    "|[─-╿][^\\s]|[^\\s][─-╿]|ÔÇ"
    "|[a-zß-ÿ][À-ÖØ-Þ‰‡·ˆ˙˚˘¸‹ﬂ§¶¤¨´≠∞≈][a-zß-ÿ]?"
    "|[‰¸ˆ˙˚˘ﬂ][a-z]|[¿¡](?:\\s|$)|[a-z]„|[a-z]ı"
    "|[À-ÖØ-öø-ÿ]{3,}"
    "|[а-яё][А-ЯЁ]"
    "|[ÃÂĂ](?![A-Za-zÀ-ſ])|\\s[√ГÃ‡](?:\\s|$)"
)
_CYRILLIC_WORDS = re.compile("[Ѐ-џ]{2,}(?:[^\\w<>\"=]{1,3}[Ѐ-џ]{1,})*")
_RUN = re.compile(r"[^\s<>]*[^\x00-\x7f][^\s<>]*(?:[ \t\xa0]+[^\s<>]*[^\x00-\x7f][^\s<>]*)*")
_C1_REF = re.compile(r"&#(?:x0*[89][0-9a-f]|0*1(?:2[89]|[345]\d));", re.I)

_DONE: dict[str, tuple[str, bool]] = {}


def judge(window: str) -> tuple[str, bool]:
    """(repaired window, whether it was damaged)."""
    got = _DONE.get(window)
    if got is None:
        best, cost, base, strict = search(window)
        hard = any(c == "�" or "\x80" <= c <= "\x9f" for c in window)
        gained = base - cost >= LEAST_GAIN[strict]
        if len(_DONE) > 200_000:
            _DONE.clear()
        got = _DONE[window] = (best if gained else window, hard or gained)
    return got


#: Share of frequent pairs under which Cyrillic words are not Russian as they stand, and the fewest pairs to tell.
RU_LIMIT, RU_PAIRS_LEAST = 0.34, 4


def _hardly_russian(text: str) -> bool:
    low = text.lower()
    pairs = [p for p in map("".join, zip(low, low[1:])) if p.isalpha() and "Ѐ" <= p[0] <= "џ" and "Ѐ" <= p[1] <= "џ"]
    return len(pairs) >= RU_PAIRS_LEAST and sum(p in _RU_PAIRS for p in pairs) < RU_LIMIT * len(pairs)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Spans worth a search."""
    for m in _RUN.finditer(text):
        run = m.group()
        if SUSPECT.search(run) or (any("Ѐ" <= c <= "џ" for c in run) and any(_hardly_russian(w.group()) for w in _CYRILLIC_WORDS.finditer(run))):
            yield from _pieces(text, *m.span())


def _pieces(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """A run in pieces that end at white space, near ``PIECE`` characters each."""
    while hi - lo > PIECE:
        m = _SPACE.search(text, lo + PIECE, hi)
        if not m:
            break
        yield lo, m.start()
        lo = m.end()
    yield lo, hi


_SPACE = re.compile(r"[ \t\xa0]+")


def _one_step(texts: list[str]) -> dict[tuple[str, str], list[str | None]]:
    """Each text after one step, by (wrong, right) codec; None where the step is impossible."""
    out: dict[tuple[str, str], list[str | None]] = {}
    for wrong in WRONG:
        there, _ = _TABLES[wrong]
        for i, t in enumerate(texts):
            try:
                data = bytes([there[ord(c)] for c in t])
            except KeyError:
                continue
            try:
                out.setdefault((wrong, "utf-8"), [None] * len(texts))[i] = data.decode("utf-8")
            except UnicodeDecodeError:
                for right in RIGHT:
                    if right != wrong:
                        out.setdefault((wrong, right), [None] * len(texts))[i] = data.decode("latin-1").translate(_DECODE[right])
    return out


def _together(texts: list[str]) -> list[str] | None:
    """The windows of a field after the one step that gains most on all of them, if it gains enough."""
    base = [implausibility(t) for t in texts]
    best, best_gain = None, 0.0
    for (_, right), got in _one_step(texts).items():
        gains = [b - implausibility(g) if g is not None else 0.0 for b, g in zip(base, got)]
        sure = right == "utf-8"
        gain = sum(gains) - (STRICT_COST if sure else LOOSE_COST)
        if gain >= LEAST_GAIN[sure] and gain > best_gain:
            best, best_gain = [g if g is not None and x > 0 else t for t, g, x in zip(texts, got, gains)], gain
    return best


def repairs(text: str) -> list[tuple[int, int, str]]:
    """Damaged spans and what they should be; a span that nothing restores stays as it is."""
    out = []
    spans = list(windows(text))
    for lo, hi in spans:
        fixed, bad = judge(text[lo:hi])
        if " " in text[lo:hi] and implausibility(fixed) > 0.5 * implausibility(text[lo:hi]):  # one bad word among good ones
            parts = [judge(w) if SUSPECT.search(w) else (w, False) for w in re.split(r"([ \t\xa0]+)", text[lo:hi])]
            wordwise = "".join(w for w, _ in parts)
            if any(b for _, b in parts) and (not bad or implausibility(wordwise) <= implausibility(fixed)):
                fixed, bad = wordwise, True
        if bad:
            out.append((lo, hi, fixed))
    if not out and len(spans) > 1:  # too little in each window, enough in all of them together
        got = _together([text[lo:hi] for lo, hi in spans])
        if got is not None:
            out = [(lo, hi, g) for (lo, hi), g in zip(spans, got)]
    return out


def _replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for lo, hi, fixed in spans:
        out += [text[at:lo], fixed]
        at = hi
    return "".join(out) + text[at:]


def repair(text: str) -> tuple[str, bool]:
    """(restored text, whether any piece was damaged)."""
    found = repairs(text)
    return (_replaced(text, found), True) if found else (text, False)


_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")


def _unescaped(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """(text without references, (begin, end) of each reference there and here)."""
    out, at, n, refs = [], 0, 0, []
    for m in _REF.finditer(text):
        plain = _html.unescape(m.group())
        if plain == m.group():
            continue
        out += [text[at : m.start()], plain]
        n += m.start() - at
        refs.append((n, n + len(plain), m.start(), m.end()))
        n += len(plain)
        at = m.end()
    out.append(text[at:])
    return "".join(out), refs


def _original(at: int, refs: list[tuple[int, int, int, int]], end: bool) -> int:
    """Where a place of the unescaped text lies in the original."""
    k = bisect.bisect_right(refs, (at, math.inf, 0, 0)) - 1
    if k < 0:
        return at
    lo, hi, olo, ohi = refs[k]
    if at >= hi:
        return ohi + at - hi
    return ohi if end and at > lo else olo


def repair_field(text: str | None) -> tuple[str | None, bool]:
    """The same over a text that may hold character references; those outside the damage stay."""
    if not text:
        return text, False
    if "&" not in text:
        return repair(text)
    plain, refs = _unescaped(text)
    spans = []
    for lo, hi, fixed in repairs(plain):
        a, b = _original(lo, refs, False), _original(hi, refs, True)
        if plain[lo:hi] != fixed:
            spans.append((a, b, _html.escape(fixed, quote=False) if "&" in text[a:b] else fixed))
        else:
            spans.append((a, b, text[a:b]))
    # references to control characters mean the letters that browsers show
    touched = [(a, b) for a, b, _ in spans]
    for m in _C1_REF.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in touched):
            spans.append((m.start(), m.end(), _html.unescape(m.group())))
    return (_replaced(text, sorted(spans)), True) if spans else (text, False)


def repair_values(values: list[str | None]) -> tuple[list[str | None], bool]:
    """Header values, each by itself; where none shows enough, all of them together."""
    got = [repair_field(v) for v in values]
    if any(bad for _, bad in got):
        return [v for v, _ in got], True
    whole, bad = repair_field("\n".join(v or "" for v in values))
    return (whole.split("\n") if bad and whole.count("\n") == len(values) - 1 else values), bad


#: RE2 superset of SUSPECT, for whole columns: a non-ASCII character or a reference to one.
_MAYBE = r"[^\x00-\x7f]|&#|&[A-Za-z]+;"


def find_damage(pages: DataFrame, with_text: bool = False) -> DataFrame:
    """``page_id, field[, restored, restored_headers]`` of damaged ``html`` and ``headers``.

    ``restored`` is the whole html and ``restored_headers`` the whole map, with the
    damaged spans replaced.  One narrow pass; only the rows found are shuffled,
    to give repeated pages once.
    """
    fields = [T.StructField("page_id", T.LongType()), T.StructField("field", T.StringType())]
    if with_text:
        fields.append(T.StructField("restored", T.StringType()))
        fields.append(T.StructField("values", T.ArrayType(T.StringType())))
        fields.append(T.StructField("keys", T.ArrayType(T.StringType())))
    schema = T.StructType(fields)
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids, htmls, heads, keys = batch.columns
                rows: list[tuple] = []
                where = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(htmls, _MAYBE), False))
                for i, t in zip(ids.take(where).to_pylist(), htmls.take(where).to_pylist()):
                    fixed, bad = repair_field(t)
                    if bad:
                        rows.append((i, "html", fixed, None, None))
                joined = pc.binary_join(heads.cast(types[3]), "\n")
                where = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(joined, _MAYBE), False))
                for i, v, k in zip(ids.take(where).to_pylist(), heads.take(where).to_pylist(), keys.take(where).to_pylist()):
                    fixed, bad = repair_values(v)
                    if bad:
                        rows.append((i, "headers", None, fixed, k))
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: len(fields)], types)], names=[f.name for f in fields])

    values = F.transform(F.map_values("headers"), lambda v: F.coalesce(v, F.lit("")))
    found = pages.select("page_id", "html", values.alias("heads"), F.map_keys("headers").alias("keys")).mapInArrow(run, schema)
    found = found.dropDuplicates(["page_id", "field"])
    if not with_text:
        return found
    return found.select("page_id", "field", "restored", F.map_from_arrays("keys", "values").alias("restored_headers"))
