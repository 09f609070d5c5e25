"""Personal data in texts, disguised identifiers included, at offsets of the source text.

Base detectors find plain emails, IPv4 addresses, card numbers and phone numbers. A transducer then rewrites
disguises (homoglyphs and full-width forms, zero-width characters, spelled digits, "at"/"dot" in brackets or
words) piece by piece and remembers where each piece of its output came from. The same detectors run over the
rewritten text, and what they find through a rewritten piece is mapped back to source characters.

Positions are code points, ends exclusive. Base spans always stay; a found span that overlaps base spans of its
kind is added only where it holds them whole, as when a disguised letter cuts the base span short. Defined results: a null text counts as empty; empty texts have no spans; rows repeat as in the
input; texts are scanned whole in time linear in their length, except for rewritten places, which are local; parts of
any number of digits are allowed, as the base patterns state. `n_*` and `base_sha256` are of base spans, `spans` of all.

A disguised address has a local part of at most four parts of up to 64 characters, and a host that ends in a listed
country or common label, or, where its dots or its "at" are unmistakable, in any label that isn't a word of prose.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
#: Matches of both lie inside such a zone, whose ends no match crosses; texts have few of them.
ZONE = re.compile(r"[0-9][0-9.\x20-]{5,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def emails(text: str) -> list[Span]:
    """The leftmost matches of local@label(.label)+ by their @ signs: a local part holds none."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def zoned(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """The leftmost matches that begin at the start of a run of digits: others can't match where that one doesn't."""
    for z in ZONE.finditer(text):
        at, end = z.span()
        while m := pattern.search(text, at, end):
            yield m
            at = m.end()


def ips(text: str) -> list[Span]:
    return [m.span() for m in zoned(IP, text) if all(len(p) < 4 and int(p or "0") < 256 for p in (x.lstrip("0") for x in m.group().split(".")))]


def card_ok(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 14 <= len(d) <= 19 and luhn(d)


def cards(text: str) -> list[Span]:
    return [m.span() for m in zoned(CARD, text) if m.end() - m.start() >= 14 and card_ok(m.group())]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m.group())) <= 15]


DETECT = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(text: str) -> dict[str, list[Span]]:
    return {k: f(text) for k, f in DETECT.items()}


# ---- disguises

#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХІЈЅοαιѵցıℓ", "aeopcyxijshdqwABEZHIKMNOPTYXABEKMHOPCTXIJSoaivgil", strict=True))
DOTS, ATS = "。．․﹒｡·∙•", "＠﹫"
ZERO_WIDTH = "​‌‍⁠﻿­"
NUMBERS = {
    "en": "zero one two three four five six seven eight nine", "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf", "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
SPELLED = {w: str(d) for line in NUMBERS.values() for d, w in enumerate(line.split())} | {"oh": "0"}
NUMBER = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
DOT_WORDS, AT_WORDS = "dot|punkt|punto|point|period", "at|arroba|arobase"


def plain(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in ZERO_WIDTH:
        return ""
    if c in DOTS:
        return "."
    if c in ATS:
        return "@"
    if c.isdecimal() or "＀" <= c <= "～" or "①" <= c <= "⓪" or "\U0001d400" <= c <= "\U0001d7ff":
        n = unicodedata.normalize("NFKC", c)
        if n.isdecimal() and not n.isascii():
            return str(unicodedata.decimal(n)) if len(n) == 1 else c
        return n if n.isascii() and n.isprintable() else c
    if c in "‐‑‒–—−":
        return "-"
    return " " if c in "    " else c


GLYPH = "[" + "".join(map(re.escape, LOOKALIKES)) + re.escape(DOTS + ATS + ZERO_WIDTH) + "＀-～①-⓪\U0001d400-\U0001d7ff٠-٩۰-۹०-९‐‑‒–—−    ]"
GLYPHS = re.compile(GLYPH)
BRACKETED = re.compile(rf"\s*[\[({{<]\s*(?:({AT_WORDS}|@)|({DOT_WORDS}|\.))\s*[\])}}>]\s*", re.I)
DASH_WORDS, PLUS_WORDS = "dash|hyphen", "plus|más|mas"
LABEL = r"[A-Za-z0-9-]+"
DOT = rf"(?:\s+(?:{DOT_WORDS})\s+|\.)"
#: Last labels that are taken after any "at" and any dot.
KNOWN = frozenset("com org net edu gov io info biz co uk de fr es eu us ch at".split())
#: Further ones that are no words and no endings of file names: taken after a bare dot and after "point", which prose has too.
LISTED = frozenset(
    "ac ad ae af ag ai al ao ar au aw ax az ba bb bd bf bg bh bi bj bm bn bo br bs bt bw bz ca cd cf cg ci ck cl cm cn cr cu cv cw cx cy cz dj dk dm dz ec ee eg er et fi fj fk fm fo ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu ie il iq ir je jm jo jp ke kg kh ki km kn kp kr kw ky kz lb lc li lk lr ls lt lu lv ly mc mg mh mk mm mn mp mq mr ms mt mu mv mw mx mz nc ne nf ng ni nl np nr nu nz om pe pf pg ph pk pl pn pr pt pw qa ro ru rw sb sc sd se sg si sj sk sl sm sn sr ss st sv sx sy sz tc td tf tg th tj tk tl tm tn tr tt tv tw tz ua ug uy uz vc ve vg vi vn vu ws yt za zm zw dev app test mobi xyz mil".split()
)
#: Words that go on with a sentence and are no country's label: never a last label.
PROSE = frozenset(
    "the and or on of for from with without that this these those there which who whom whose when where while then than but if an are was were been being have has had he she we they you his her its their our your not into onto over under after before between about above below again also just only very can could will would shall should may might must "
    "der die das und oder auf für von vom mit ist sind war ein eine einen dem den des im zu zum zur nicht wie wenn als sich wir sie ihr le les un une et ou du des dans pour sur avec est sont qui que dont où el los las unos unas y o del con para por que como donde es son".split()
) - KNOWN
#: What follows the "at": labels and dots; what may stand before it.
AT = re.compile(rf"\s+({AT_WORDS})\s+|@", re.I)
HOST = re.compile(rf"{LABEL}(?:{DOT}{LABEL})+(?![A-Za-z0-9-])", re.I)
HOST_PART = re.compile(rf"({DOT})({LABEL})", re.I)
NAME = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}$", re.I)
NO_HOST = frozenset("the a an this that these those my your our his her its their any some each every one no".split())
#: Signs of a written-out address that prose lacks or seldom has.
CLEAR_AT, CLEAR_DOT = frozenset(("@", "arroba", "arobase")), frozenset(("dot", "punkt", "punto"))
WORDED_DOT = re.compile(rf"\s+(?:{DOT_WORDS})\s+", re.I)
#: A run of four or more digits, some of them spelled; dots, dashes and a plus may be spelled too.
SAID, SAID_LONG = (
    re.compile(rf"(?:\b(?:{PLUS_WORDS})\s+|\+\s*)?\b(?:{NUMBER}|{g})\b(?:(?:[\s,.()-]{{1,3}}|\s+(?:{DOT_WORDS}|{DASH_WORDS})\s+)(?:{NUMBER}|{g})\b){{3,}}", re.I)
    for g in ("[0-9]{1,4}", "[0-9]+")
)
#: Where a group is longer, the text is read both ways: it may be a part of the number or stand before it.
LONG_GROUP = re.compile(rf"[\d{ZERO_WIDTH}①-⓪]{{5}}")
SAID_WORD = re.compile(rf"\b(?:{NUMBER}|{DOT_WORDS}|{DASH_WORDS}|{PLUS_WORDS})\b", re.I)
SAID_PART = re.compile(rf"(\b(?:{PLUS_WORDS})\s+|\+\s*)|\b({NUMBER})\b|([0-9]+)|([\s,]+(?:{DOT_WORDS})\s+|\.)|([\s,()-]+({DASH_WORDS})?[\s,()-]*)", re.I)
#: Cheap tests for a disguise, on the text's lower-cased words: without a hint a transducer returns the text as it is.
SPLIT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
SAID_HINT = frozenset(w.encode() for w in SPELLED)
AT_HINT, DOT_HINT, JOINT_HINT = (frozenset(x.encode() for x in w.split("|")) for w in (AT_WORDS, DOT_WORDS, f"{DOT_WORDS}|{DASH_WORDS}|{PLUS_WORDS}"))
SAY_HINT = SAID_HINT | JOINT_HINT


def hints(text: str) -> tuple[bool, bool]:
    """(spelled digits may be there, a worded address may be there)."""
    tokens = text.lower().encode("utf-8", "surrogatepass").translate(SPLIT).split()
    kinds = set(tokens)
    # a spelled digit, dot, dash or plus beside another one or a digit
    said = not SAY_HINT.isdisjoint(kinds) and any(n in SAY_HINT or n.isdigit() if w in SAY_HINT else n in SAY_HINT and w.isdigit() for w, n in zip(tokens, tokens[1:], strict=False))
    return said, not AT_HINT.isdisjoint(kinds) or "@" in text and not DOT_HINT.isdisjoint(kinds)


Piece = tuple[int, int, str]


def rewrite(text: str, pieces: list[Piece]) -> tuple[str, "Offsets"]:
    """The text with each piece (start, end, new) replaced; of overlapping pieces the first stays."""
    out, starts, sources, at, length = [], [0], [(0, 0, False)], 0, 0
    for a, b, new in sorted(pieces):
        if a < at:
            continue
        out += (text[at:a], new)
        length += a - at
        starts += (length, length + len(new))
        sources += ((a, b, True), (b, b, False))
        length += len(new)
        at = b
    out.append(text[at:])
    return "".join(out), Offsets(starts, sources)


class Offsets:
    """From positions of a rewritten text to those of its source."""

    def __init__(self, starts: list[int], sources: list[tuple[int, int, bool]]):
        self.starts, self.sources = starts, sources

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of an output span, and whether a rewritten piece has a part in it."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        (a, _, new_a), (b, b_end, new_b) = self.sources[i], self.sources[j]
        changed = any(new and self.starts[i + k] < end for k, (_, _, new) in enumerate(self.sources[i : j + 1]))
        return (a if new_a else a + start - self.starts[i]), (b_end if new_b else b + end - self.starts[j]), changed


def host_end(text: str, at: str, start: int) -> int:
    """Where the host name that starts at `start` ends, after the mark `at`; -1 if there is none."""
    host = HOST.match(text, start)
    if not host or re.split(r"[\s.]", host.group(), maxsplit=1)[0].lower() in NO_HOST:
        return -1
    end = -1
    for p in HOST_PART.finditer(text, start, host.end()):
        dot, last = p.group(1).strip().lower(), p.group(2).lower()
        clear = dot in CLEAR_DOT or at.lower() in CLEAR_AT
        if last in KNOWN or last in LISTED or clear and last not in PROSE and len(last) > 1 and last.isalpha():
            end = p.end()
    return end


def stages(text: str, pattern: re.Pattern = SAID) -> Iterator[list[Piece]]:
    """The pieces that each transducer rewrites; each gets the text that the one before it made."""
    glyphs = [(m.start(), m.end(), plain(m.group())) for m in GLYPHS.finditer(text)] if not text.isascii() else []
    text = yield [p for p in glyphs if p[2] != text[p[0] : p[1]]]
    said: list[Piece] = []
    may_say, may_word = hints(text)
    if may_say:
        for m in pattern.finditer(text):
            if not SAID_WORD.search(m.group()):
                continue
            parts = list(SAID_PART.finditer(text, m.start(), m.end()))
            for i, p in enumerate(parts):
                plus, word, _, dot, gap, dash = p.groups()
                if plus:
                    said.append((*p.span(), "+"))
                elif word:
                    said.append((*p.span(), SPELLED[word.lower()]))
                elif dot and dot != ".":
                    said.append((*p.span(), "."))
                elif gap and 0 < i < len(parts) - 1:
                    near = parts[i - 1].group(2) or parts[i + 1].group(2)
                    said.append((*p.span(), "" if near else "-" if dash else gap))
    text = yield [p for p in said if p[2] != text[p[0] : p[1]]]
    marks = [(*m.span(), "@" if m.group(1) else ".") for m in BRACKETED.finditer(text)] if any(c in text for c in "[({<") else []
    text = yield marks
    worded: list[Piece] = []
    for m in AT.finditer(text) if may_word or marks else ():
        end = host_end(text, m.group(1) or "@", m.end())
        if end < 0:
            continue
        near = max(0, m.start() - 280)
        if name := NAME.search(text[near : m.start()]):
            worded += [(*m.span(), "@")] + [(*x.span(), ".") for x in WORDED_DOT.finditer(text, m.end(), end)]
            worded += [(near + x.start(), near + x.end(), ".") for x in WORDED_DOT.finditer(text[near : m.start()], *name.span())]
    worded = [p for p in worded if p[2] != text[p[0] : p[1]]]
    yield worded


def hidden_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text or a single token shows, at source positions."""
    found: dict[str, set[Span]] = {k: set() for k in KINDS}
    # a run of digits and single gaps that is no card may hold whole cards, each a token
    for m in zoned(CARD, text):
        if m.end() - m.start() >= 29 and not card_ok(m.group()):
            for t in re.finditer(r"[0-9]+", m.group()):
                if card_ok(t.group()):
                    found["card"].add((m.start() + t.start(), m.start() + t.end()))
    long_group = LONG_GROUP.search(text) and (not text.isascii() or hints(text)[0])
    for pattern in (SAID, SAID_LONG) if long_group else (SAID,):
        maps: list[Offsets] = []
        steps = stages(text, pattern)
        pieces, now = next(steps), text
        while True:
            if pieces:
                now, offsets = rewrite(now, pieces)
                maps.append(offsets)
            try:
                pieces = steps.send(now)
            except StopIteration:
                break
        for kind, detect in DETECT.items() if maps else ():
            for a, b in detect(now):
                changed = False
                for offsets in reversed(maps):
                    a, b, new = offsets.back(a, b)
                    changed |= new
                if changed:
                    found[kind].add((a, b))
    out = {}
    for kind, spans in found.items():
        taken = sorted(base[kind])
        kept: list[Span] = []
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            first, last = bisect_right(taken, (a, -1)), bisect_right(taken, (b - 1, 1 << 60))
            first -= first > 0 and taken[first - 1][1] > a
            near = taken[first:last]
            wider = all(a <= x and y <= b for x, y in near) and near != [(a, b)]
            if wider and (not kept or kept[-1][1] <= a):
                kept.append((a, b))
        out[kind] = kept
    return out


def line(spans: dict[str, list[Span]]) -> str:
    rows = sorted((a, KINDS.index(k), b) for k, ss in spans.items() for a, b in ss)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) by kind."""
    text = text or ""
    base = base_spans(text)
    more = hidden_spans(text, base)
    return base, {k: sorted(base[k] + more[k]) for k in KINDS}


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans; one row for each row of `docs`."""
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"], strict=True):
                base, every = find(t)
                rows.append((k, *(len(base[x]) for x in KINDS), hashlib.sha256(line(base).encode()).hexdigest(), line(every)))
            yield pd.DataFrame(rows, columns=["key", *(f"n_{x}" for x in KINDS), "base_sha256", "spans"])

    schema = "key {}, " + ", ".join(f"n_{x} long" for x in KINDS) + ", base_sha256 string, spans string"
    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(made, schema.format(kind)).withColumnRenamed("key", key)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are masked as one, by the first."""
    if not text:
        return text
    _, every = find(text)
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, ss in every.items() for a, b in ss):
        if a >= at:
            out += (text[at:a], f"[{k.upper()}]")
        at = max(at, -b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`docs` with its texts masked (and their length column, if any, made anew); all other columns stay."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(masked)

    out = docs.withColumn(text, mask(text))
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length in docs.columns else out


def op6(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
