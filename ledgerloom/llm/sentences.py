"""Problem 8: sentence units of texts in any language and script.

A hidden-event n-gram language model puts boundary tokens between words. Empty lines are boundaries, and positions inside a quotation
or before a word in small letters are none; of all other positions where a sentence may end (after a period, an ellipsis, a closed
quotation, or at a space in scripts that have no period) the model weighs a boundary, with the next words as the start of a
sentence, against the same words as a continuation. Forward-backward posteriors along a paragraph decide. The model learns from the
starts and ends of paragraphs and, by expectation maximisation, from its own posteriors, on all texts. Words of few places are known by
their shape only, so the model stays small, and runs of places that look the same to it are counted once: each round is a sum over them.
Each text is read once: what it teaches and where its units may end come from the same pass, and only these places are kept for the end.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut, spread

ROUNDS = 4
#: A word is known by itself if it stands at KNOWN places, starts sentences if it begins BEGINS paragraphs, and is whole if it stands BARE
#: times without a period. These hold for up to PER texts and grow with the texts beyond, as chance cases do. Weights are summed as
#: whole numbers of a UNIT-th, so that the model is the same whatever the partitioning.
KNOWN, BEGINS, BARE, PER, UNIT = 4, 3, 2, 4_000, 1_000_000
#: Fixed value: Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
EMPTY_LINE = re.compile(f"(?:\r\n|\n|\r(?!\n)|[\x85 ])[{SPACE}]*[\n\r\x85 ]| ")
NOT_SPACE = re.compile(f"[^{SPACE}]")
LAST_NOT_SPACE = re.compile(f"[^{SPACE}](?=[{SPACE}]*\\Z)")
THAI = "฀-๿"
#: Han and Kana.
HAN = "぀-ヿ㐀-鿿豈-﫿"
#: What may stand behind an end mark: more of them, then what closes.
CLOSING = "[.!?…。！？।؟۔]*(?:[   ]?[»›]|[\"”’'」』）)\\]]|“(?=[\\s,.;:)]|\\Z))*"
#: Where a unit may end: end marks with what closes behind them, or a space next to a script that puts no mark there (always in
#: Thai; in Chinese and Japanese where a sentence carries none).
MAY_END = re.compile(
    "(?:\\.(?![0-9])|[!?…。！？।؟۔])" + CLOSING +
    f"|(?=[  　])(?:(?<=[{THAI}0-9%A-Za-z])(?=[  　]+[{THAI}])|(?<=[{HAN}])(?=[  　]+(?:[^\\W_]|[\"“„«「『《（(]))|(?<=[0-9%％A-Za-z])(?=[  　]+[{HAN}]))"
)
#: The same in texts without Han, Kana and Thai, led by one set of characters, which is found faster.
MARK_ENDS = re.compile("[.!?…。！？।؟۔](?:(?<!\\.)|(?![0-9]))" + CLOSING)
#: The kind of a place at a space next to Han or Kana; it has counts of its own, apart from those of Thai.
WIDE = "\u3000"
#: The number of a heading in Chinese or Japanese.
NUMBERED = re.compile("第[0-9０-９〇零一二三四五六七八九十百]+[章节節項项条條部編编回号號]?")
QUOTES = re.compile("[“”„«»「」『』\"()（）]")
CLOSES = {"”": "“", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（"}
CONTINUES = frozenset(",;:–—-/%&=+*·，、；：）」』”’»)]}|~")
CLOSERS = frozenset("\"”’“'」』）)]»›")
GOES_ON = CONTINUES | frozenset(".!?…。！？।؟")
UNSPACED = f"{HAN}{THAI}"
HAS_UNSPACED = re.compile(f"[{UNSPACED}]")
#: Letters of spaced scripts with the marks that belong to them.
LETTER = f"(?:(?![{UNSPACED}])[^\\W\\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0970-\u097f])"
#: A token beside a boundary: a word, a number, up to two characters of an unspaced script (four of Thai), or a sign.
RIGHT = f"[{THAI}]{{1,4}}|[{UNSPACED}]{{1,2}}|\\d+|{LETTER}+['’]?|[^{SPACE}]"
#: The same, read backwards; letters with periods between them are one word.
LEFT = f"[{THAI}]{{1,4}}|[{UNSPACED}]{{1,2}}|\\d+|{LETTER}\\.{LETTER}(?:\\.{LETTER})*(?!{LETTER})|{LETTER}+|[^{SPACE}]"
TWO_RIGHT = re.compile(f"[{SPACE}]*+({RIGHT})?[{SPACE}]*+({RIGHT})?")
TWO_LEFT = re.compile(f"\\s*+({LEFT})\\s*+({LEFT})?")
#: The same in plain text, which is found faster.
PLAIN_RIGHT = "[0-9]+|[A-Za-z]+'?|[^\t-\r ]"
PLAIN_LEFT = "[0-9]+|[A-Za-z]\\.[A-Za-z](?:\\.[A-Za-z])*(?![A-Za-z])|[A-Za-z]+|[^\t-\r ]"
TWO_PLAIN_RIGHT = re.compile(f"[\t-\r ]*+({PLAIN_RIGHT})?[\t-\r ]*+({PLAIN_RIGHT})?")
TWO_PLAIN_LEFT = re.compile(f"\\s*+({PLAIN_LEFT})\\s*+({PLAIN_LEFT})?")
#: Fixed value: words whose period seldom ends a sentence; each counts as a few seen cases.
ABBREVIATIONS = """Mr Mrs Ms Dr Prof St Ft Jr Sr No Nos vs e.g i.e cf approx Approx Fig fig Sec sec Art art Exh Doc fn p pp ext Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec
Nr Abs Hr Fr bzw z B d h u a vgl S ff Ca ca rd Gem Mio Mrd M Mme Mlle al env n annexe Sr Sra Dra D pág núm Uds Ud apdo ej mill no Co Corp Inc Ltd Bros Vol Rev excl yr Hon Gen Capt Messrs Ave""".split()


KNOWN_ABBREVIATIONS = frozenset(ABBREVIATIONS)


def shape(token: str) -> str:
    """What a word that is too rare to be known looks like."""
    if token.isdigit():
        return "0"
    if len(token) == 1 and token.isalpha() and token.upper() != token.lower():
        return "A" if token.isupper() else "a"
    if token.isalpha():
        return "AA" if token.isupper() and token.lower() != token else "Aa" if token[0].isupper() else "aa" if token.islower() else f"w{ord(token[0]) >> 8}"
    return token


def script(token: str) -> str:
    """The script of a token; signs and numbers go with Latin."""
    c = token[0]
    return "T" if "\u0e00" <= c <= "\u0e7f" else "C" if _unspaced(c) and c not in "“" else "A" if "\u0600" <= c <= "\u06ff" else "D" if "\u0900" <= c <= "\u097f" else "L"


def left_tokens(text: str, end: int, start: int) -> tuple[str, str, int]:
    """(the token before end, the one before that, where the first starts); <s> at the start of a paragraph."""
    low = max(start, end - 48)
    back = text[low:end][::-1]
    m = (TWO_PLAIN_LEFT if back.isascii() else TWO_LEFT).match(back)
    if not m:
        return "<s>", "<s>", end
    first, second = m.groups()
    if second is None:
        second = "<s>"
    else:
        second = "<s>" + second[::-1] if low == start and m.end() == end - low else second[::-1]
    return first[::-1], second, end - m.end(1)


def right_tokens(text: str, at: int, end: int) -> tuple[str, str]:
    ahead = text[at : min(end, at + 40)]
    return (TWO_PLAIN_RIGHT if ahead.isascii() else TWO_RIGHT).match(ahead).groups("</s>")


def held(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The spans of closed quotations and brackets, nested ones within the outer."""
    spans, stack = [], []
    for m in QUOTES.finditer(text, start, end):
        c, at = m[0], m.start()
        if c == '"':
            open_ = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if open_ is None:
                stack.append((c, at))
            else:
                spans.append((stack[open_][1], at))
                del stack[open_:]
        elif c == "“" and any(o == "„" for o, _ in stack):
            k = max(k for k, (o, _) in enumerate(stack) if o == "„")
            spans.append((stack[k][1], at))
            del stack[k:]
        elif c in CLOSES:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == CLOSES[c]), None)
            if k is not None:
                spans.append((stack[k][1], at))
                del stack[k:]
        else:
            stack.append((c, at))
    return spans


NO, ASK, YES = 0, 1, 2


class Seen:
    """What texts teach: how often they have each run of places, each pair of edges of a paragraph, and each word beside them.

    A place whose context holds no earlier one starts a run; what is before it has no part in its posterior.
    """

    def __init__(self) -> None:
        self.texts, self.counts = 0, {kind: Counter() for kind in ("run", "edge", "left", "right", "begin", "chunk")}
        self.new: dict[str, list[str]] = {kind: [] for kind in self.counts}

    def settle(self) -> int:
        """Count what is new; the number of different items."""
        for kind, items in self.new.items():
            self.counts[kind].update(items)
            items.clear()
        return sum(map(len, self.counts.values()))

    def items(self) -> Iterator[tuple[str, str, int]]:
        """(kind, item, how often), with the words that stand without a period behind them in place of the chunks between spaces."""
        self.settle()
        bare: Counter = Counter()
        for chunk, n in self.counts["chunk"].items():
            for w in BARE_WORD.findall(chunk):
                bare[w] += n
        yield "text", "", self.texts
        for kind, counts in (self.counts | {"chunk": bare}).items():
            for item, n in counts.items():
                yield "bare" if kind == "chunk" else kind, item, n


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs between empty lines, without white space at either end."""
    at = 0
    cuts = [m.span() for m in EMPTY_LINE.finditer(text)] + [(len(text), len(text))]
    for a, b in cuts:
        first = NOT_SPACE.search(text, at, a)
        if first:
            last = a
            while text[last - 1].isspace():
                last -= 1
            yield first.start(), last
        at = b


def places(text: str, start: int, end: int, may_end: re.Pattern, seen: Seen | None = None) -> list[tuple[int, int, int, str, bool]]:
    """(end of the unit, start of the next, verdict, context, near) of each place of one paragraph; its own end is none of them.

    A context is written as kind, two tokens to the left, two to the right, by tabs. Only places for the model have one, and only they
    may be near, that is hold the place before in their context. seen learns of all places, also those where a text just goes on:
    without the tokens to the right where there is no boundary, and with a tab behind where there is one.
    """
    out: list[tuple[int, int, int, str, bool]] = []
    spans = None
    run, last = "", -9
    if seen is not None:
        to_left, to_right, to_runs = (seen.new[kind].append for kind in ("left", "right", "run"))
    for m in may_end.finditer(text, start, end):
        a, b = m.span()
        if b >= end:
            break
        mark = text[a:b]
        nxt = text[b]
        if mark and not nxt.isspace():
            c = text[b - 1]
            if c in ".…" and len(mark) == 1 and c == "." or mark[0] in ".!?" and c in CLOSERS and not _unspaced(nxt):
                # a period inside a word or number, unless a space is missing between two sentences
                if not (nxt.isupper() and b + 1 < end and text[b + 1].islower() and a - start > 2 and text[a - 1].islower() and text[a - 2].islower()):
                    continue
                word = text[text.rfind(" ", start, a) + 1 : a]
                if "@" in word or "/" in word or word.lower().endswith("www") or "." in word and not word[0].isupper():
                    continue
            elif not (_unspaced(nxt) or _unspaced(text[a - 1]) or c in "…।؟۔"):
                continue
            at = b
        else:
            at = b + 1
            if at >= end or nxt != " " or text[at].isspace():
                f = NOT_SPACE.search(text, b, end)
                if not f:
                    break
                at = f.start()
            nxt = text[at]
        verdict, closed = ASK, mark[-1:] in CLOSERS
        low = nxt.islower()
        camel = low and text[at + 1 : at + 2].isupper()
        goes_on = nxt in GOES_ON or low and not camel
        if goes_on:
            if seen is None:
                continue
            verdict = NO
        else:
            if spans is None:
                spans = held(text, start, end)
            if spans and any(x < a and b <= y for x, y in spans):
                continue
            upper = camel or nxt.isupper()
            if nxt in "(（" and not _whole_bracket(text, at, spans):
                verdict = NO
            elif mark and mark[0] in "!?。！？।؟۔" and (not closed or upper) or closed and upper:
                verdict = YES
            elif mark == "." and (text[a - 1] in CLOSERS and upper or nxt in "\"“„«" and text[at + 1 : at + 3].strip()[:1].isupper()):
                verdict = YES
        if verdict != ASK and seen is None:
            out.append((b, at, verdict, "", False))
            continue
        l1, l2, began = left_tokens(text, a, start)
        r1, r2 = right_tokens(text, at, end)
        taught = verdict
        if mark == ".":
            kind = mark
            if len(l1) < 3 and l1.isdigit() and l2[:3] == "<s>":
                taught = NO  # the number of a heading
            elif verdict == YES and (l1 in KNOWN_ABBREVIATIONS or len(l1) == 1 and l1.isalpha()):
                taught = ASK
        elif mark:
            kind = "…" if "…" in mark or ".." in mark else mark[0] + "”" if closed else mark[0]
        else:
            kind = " " if "\u0e00" <= nxt <= "\u0e7f" else WIDE
            if NUMBERED.fullmatch(text, start, a):
                taught = NO
        context = f"{kind}\t{l1}\t{l2}\t{r1}\t{r2}"
        if seen is not None:
            to_left(l1)
            to_right(r1)
            told = context if taught == ASK else context + "\t" if taught == YES else f"{kind}\t{l1}\t{l2}"
            if run and began <= last + 2:
                run += "\n" + told
            else:
                if run:
                    to_runs(run)
                run = told
            last = b
        if verdict != ASK or taught == NO:
            if not goes_on:
                out.append((b, at, verdict if verdict != ASK else NO, "", False))
        else:
            out.append((b, at, ASK, context, bool(out) and began <= out[-1][0] + 2))
    if run:
        to_runs(run)
    return out


def tail(text: str, start: int, end: int) -> tuple[str, str, str] | None:
    """(the last two tokens of a paragraph, its kind of end), or None for a heading."""
    m = MAY_END.search(text, max(start, end - 8), end)
    if m and m[0] and m.end() == end:
        return *left_tokens(text, m.start(), start)[:2], (m[0][0] + ("”" if m[0][-1] in CLOSERS else "")) if "…" not in m[0] else "…"
    if THAI_END.search(text, max(start, end - 16), end) and end - start > 15:
        return *left_tokens(text, end, start)[:2], " "
    if HAN_END.match(text, end - 1) and end - start > 15:
        return *left_tokens(text, end, start)[:2], WIDE
    return None


def pieces(text: str, seen: Seen | None = None) -> tuple[list[int], list[int], list[str]]:
    """(starts, ends, runs) of the pieces between the places where units end or may end.

    The end is inverted (~) where the model decides. runs are the runs of places that hold such ones in their order, by lines: a
    context, or the verdict of a place that is already decided.
    """
    starts: list[int] = []
    ends: list[int] = []
    runs: list[str] = []
    may_end = MARK_ENDS if text.isascii() or not HAS_UNSPACED.search(text) else MAY_END
    if seen is not None:
        seen.texts += 1
        seen.new["chunk"] += text.split()
    for start, end in paragraphs(text):
        starts.append(start)
        run, asked = "", False
        for b, at, verdict, context, near in places(text, start, end, may_end, seen):
            if near:
                run += "\n" + context
            else:
                if asked:
                    runs.append(run)
                run, asked = context or str(verdict), False
            if verdict == ASK:
                asked = True
                ends.append(~b)
                starts.append(at)
            elif verdict == YES:
                ends.append(b)
                starts.append(at)
        if asked:
            runs.append(run)
        ends.append(end)
        # a heading is no sentence: only a paragraph with an end mark shows how sentences start
        if seen is not None and (got := tail(text, start, end)):
            r1, r2 = right_tokens(text, start, end)
            seen.new["edge"].append("\t".join((r1, r2, *got)))
            seen.new["left"].append(got[0])
            seen.new["right"].append(r1)
            seen.new["begin"].append(r1)
    return starts, ends, runs


def _unspaced(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "฀" <= c <= "๿" or c in "「『“（《"


def _whole_bracket(text: str, at: int, spans: list[tuple[int, int]]) -> bool:
    """Whether the bracket that opens at a place holds a whole sentence."""
    close = next((y for x, y in spans if x == at), None)
    return close is not None and text[close - 1] in ".!?。！？…" and text[at + 1 : at + 2].isupper()


class Place(NamedTuple):
    """A place as the model sees it: words that are not known are shapes. A place that is sure counts as decided."""

    verdict: int
    near: bool
    guess: float | None
    kind: str
    form: str
    l1: str
    l2: str
    r1: str
    r2: str
    of: str
    kana: bool


#: A decided place before a run.
BEGUN = Place(YES, False, None, "", "", "", "", "", "", "", False)


class BoundaryModel:
    """Counts of the hidden-event model, and the odds that they give."""

    def __init__(self) -> None:
        self.known_left: set[str] = set()
        self.known_right: set[str] = set()
        self.whole: set[str] = set()  # words that stand without a period, too
        self.ends: dict = defaultdict(lambda: [0.0, 0.0])  # context -> [no boundary, boundary]
        self.starts: Counter = Counter()  # right context -> weight at sentence starts
        self.goes_on: dict = defaultdict(float)  # (left context, right word) -> weight without a boundary
        self.goes_on_all: dict = defaultdict(float)
        self.base: Counter = Counter()
        self.cache: dict = {}

    def left(self, w: str) -> str:
        bare = w[3:] if w.startswith("<s>") else w
        return w if bare in self.known_left or not bare else w[: len(w) - len(bare)] + shape(bare)

    def right(self, w: str) -> str:
        return w if w in self.known_right or w == "</s>" else shape(w)

    def sure(self, kind: str, w: str) -> bool:
        """Whether a period ends a sentence whatever follows: behind a year, a whole word or a word too long to be cut short."""
        if kind != "." or w in KNOWN_ABBREVIATIONS:
            return False
        return w in self.whole or (len(w) > 4 and w.isalpha()) or (len(w) == 4 and w[:2] in ("19", "20") and w.isdigit())

    def place(self, context: str, near: bool, guess: Callable[[int, str, str, str], float | None] | None = None) -> Place:
        """A context as places and pieces write it, by what is known of its words; guess gives its first weight."""
        got = context.split("\t")
        if len(got) == 1:
            return BEGUN._replace(verdict=int(context), near=near)
        kind, l1, l2 = got[:3]
        verdict = ASK if len(got) == 5 else YES if len(got) == 6 else NO
        first = guess(verdict, kind, l1, got[3] if verdict != NO else "") if guess else None
        if verdict == NO:
            return Place(NO, near, first, kind, shape(l1), self.left(l1), self.left(l2), "", "", "", False)
        r1, r2 = got[3:5]
        if verdict == ASK and self.sure(kind, l1):
            verdict = YES
        return Place(verdict, near, first, kind, shape(l1), self.left(l1), self.left(l2), self.right(r1), self.right(r2), script(r1), "ぁ" <= l1[-1] <= "ん")

    def add(self, table: str, key, no: int, yes: int) -> None:
        if table == "ends":
            self.ends[key][0] += no
            self.ends[key][1] += yes
        else:
            getattr(self, table)[key] += yes

    def sums(self) -> Iterator[tuple[str, object, int, int]]:
        """What add takes: (table, key, without a boundary, with one); other tables than ends have one number."""
        for key, (no, yes) in self.ends.items():
            yield "ends", key, no, yes
        for table in ("starts", "goes_on", "goes_on_all"):
            for key, n in getattr(self, table).items():
                yield table, key, 0, n

    def contexts(self, p: Place, fresh: bool) -> tuple:
        l2 = "<s>" if fresh else p.l2
        if p.kind == WIDE:  # most spaces beside Han are no boundary: only the words before them show one
            return (p.kind, p.l1), (p.kind, p.l1, l2)
        return (p.kind,), (p.kind, p.form), (p.kind, p.l1), (p.kind, p.l1, l2)

    def note(self, p: Place, weight: float, n: int = 1) -> None:
        """Count n places that are boundaries with some weight, in parts of UNIT."""
        much = 0.15 if p.verdict == NO else 1.0
        yes, no = round(weight * much * UNIT) * n, round((1 - weight) * much * UNIT) * n
        for c in self.contexts(p, False):
            self.ends[c][1] += yes
            self.ends[c][0] += no
        if p.verdict != NO:
            if yes:
                self.note_start(p.r1, p.r2, p.of, yes)
            if no:
                for key in ((p.kind, p.of, p.r1), (p.kind, p.of, p.l1, p.r1)):
                    self.goes_on[key] += no
                for key in ((p.kind, p.of), (p.kind, p.of, p.l1)):
                    self.goes_on_all[key] += no

    def note_start(self, a: str, b: str, of: str, weight: float) -> None:
        self.starts[(a, b)] += weight
        self.starts[a] += weight
        self.starts["", of] += weight

    def note_end(self, form: str, l1: str, l2: str, kind: str, weight: float) -> None:
        for c in ((kind,), (kind, form), (kind, l1), (kind, l1, l2)):
            self.ends[c][1] += weight

    def chance(self, p: Place, fresh: bool = False) -> tuple[float, float]:
        """(weight of no boundary, weight of a boundary) at a place, its next words included."""
        key = (*p[3:], fresh)
        if (hit := self.cache.get(key)) is not None:
            return hit
        end = 0.97 if p.kind == " " else 0.5
        if p.kind == WIDE:
            # an inflected Japanese word that stands before end marks may end a sentence that carries none
            marked = self.ends.get(("。", p.l1), (0, 0))
            end = 0.6 if marked[1] >= 2 and p.kana else 0.3
        for c in self.contexts(p, fresh):
            n = self.ends.get(c)
            if n:
                end = (n[1] + 2 * end) / (n[0] + n[1] + 2)
        # next words compete within their script, so that a rare script is not outvoted
        a, b, l1, of = p.r1, p.r2, p.l1, p.of
        base = (self.base[a] + 0.5) / (self.base["", of] + 50)
        start = (self.starts[a] + 5 * base) / (self.starts["", of] + 5)
        start = 0.5 * start + 0.5 * start * ((self.starts[(a, b)] + 1) / (self.starts[a] + 1))
        on = (self.goes_on.get((p.kind, of, a), 0) + 5 * base) / (self.goes_on_all.get((p.kind, of), 0) + 5)
        on = (self.goes_on.get((p.kind, of, l1, a), 0) + 3 * on) / (self.goes_on_all.get((p.kind, of, l1), 0) + 3)
        if p.kind == WIDE and of == "L":  # a name or number beside Han is not counted with the words of Latin texts
            on, start = 1.0, 0.5
        out = ((1 - end) * on, end * start)
        if len(self.cache) < 200_000:
            self.cache[key] = out
        return out

    def decided(self, run: str) -> list[bool]:
        """Whether a unit ends at each place of a run that is left to the model."""
        contexts = run.split("\n")
        if len(contexts) == 1 and self.sure(*run.split("\t", 2)[:2]):
            return [True]
        chain = [self.place(c, i > 0) for i, c in enumerate(contexts)]
        return [w > 0.5 for c, w in zip(contexts, self.posteriors(chain)) if len(c) > 1]

    def posteriors(self, chain: list[Place]) -> list[float]:
        """The chance of a boundary at each place of a paragraph, by forward and backward sums over its chain."""
        n = len(chain)
        move = []
        for p in chain:
            if p.verdict == YES:
                rows = ((0.0, 1.0), (0.0, 1.0))
            elif p.verdict == NO:
                rows = ((1.0, 0.0), (1.0, 0.0))
            else:
                plain = self.chance(p)
                rows = (plain, self.chance(p, True) if p.near else plain)
            move.append(rows)
        if not any(p.near for p in chain):
            return [r[0][1] / (r[0][0] + r[0][1]) for r in move]
        fore, state = [], (1.0, 0.0)
        for rows in move:
            x = (state[0] * rows[0][0] + state[1] * rows[1][0], state[0] * rows[0][1] + state[1] * rows[1][1])
            s = x[0] + x[1]
            state = (x[0] / s, x[1] / s)
            fore.append(state)
        back = [(1.0, 1.0)] * n
        for i in range(n - 2, -1, -1):
            rows, nxt = move[i + 1], back[i + 1]
            x = (rows[0][0] * nxt[0] + rows[0][1] * nxt[1], rows[1][0] * nxt[0] + rows[1][1] * nxt[1])
            s = max(x) or 1.0
            back[i] = (x[0] / s, x[1] / s)
        return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(fore, back)]


def at_least(n: int, texts: int) -> int:
    return max(n, math.ceil(n * texts / PER))


def based(rights: Iterable[tuple[str, str, int]]) -> Counter:
    """How many places have each right word, or shape, and each script."""
    base: Counter = Counter()
    for word, of, n in rights:
        base[word] += n
        base["", of] += n
    return base


class Rules:
    """What is known of the words beside places before the first round."""

    def __init__(self, known_left: set[str], known_right: set[str], whole: set[str], at_places: set[str], begins: set[str], base: Counter) -> None:
        self.known_left, self.known_right, self.base = known_left | set(ABBREVIATIONS), known_right, base
        # a word that starts paragraphs again and again starts sentences; one that stands without a period is no abbreviation
        self.starter = {w for w in begins if w.rstrip("'’").isalpha() and len(w) > 1 and w not in KNOWN_ABBREVIATIONS}
        self.whole = whole - KNOWN_ABBREVIATIONS
        self.at_places = at_places & self.whole

    def blank(self) -> BoundaryModel:
        model = BoundaryModel()
        model.known_left, model.known_right, model.whole, model.base = self.known_left, self.known_right, self.whole, self.base
        return model

    def start(self, fixed: dict[str, BoundaryModel], model: BoundaryModel | None) -> BoundaryModel:
        """A round's sums of what is decided."""
        out = self.blank()
        for when in ("always", "later" if model else "first"):
            for row in fixed[when].sums():
                out.add(*row)
        return out

    def guess(self, verdict: int, kind: str, l1: str, r1: str) -> float | None:
        if verdict != ASK:
            return float(verdict == YES)
        if kind == ".":
            return 1.0 if r1 in self.starter else 0.0 if l1 in KNOWN_ABBREVIATIONS else 0.9 if l1 in self.whole else None
        return 0.8 if kind == " " else None

    def alike(self, counts: Iterable[tuple[str, str, int]]) -> Counter:
        """("run", places of the model), ("place", one that is decided) and ("edge", how a paragraph starts and ends) by what is known of
        their words, with the sum of their counts. What is before a decided place has no part in what is behind it, so runs end there."""
        out: Counter = Counter()
        model = self.blank()
        known: dict = {}
        for kind, item, n in counts:
            if kind == "edge":
                r1, r2, l1, l2, ends = item.split("\t")
                out["edge", ((model.right(r1), model.right(r2), script(r1)), (shape(l1), model.left(l1), model.left(l2), ends))] += n
                continue
            chain: list[Place] = []
            for i, context in enumerate(item.split("\n")):
                if (p := known.get((context, i > 0))) is None:
                    p = model.place(context, i > 0, self.guess)
                    if len(known) < 200_000:
                        known[context, i > 0] = p
                if p.verdict == ASK:
                    chain.append(p)
                    continue
                out["place", p] += n
                if chain and chain[-1].verdict == ASK:
                    out["run", tuple(chain)] += n
                chain = [BEGUN] if p.verdict == YES else []
            if chain and chain[-1].verdict == ASK:
                out["run", tuple(chain)] += n
        return out

    def fixed(self, alike: Counter) -> dict[str, BoundaryModel]:
        """The sums of what is decided, those of "always", and those of the "first" round and of "later" ones only."""
        sums = {when: self.blank() for when in ("always", "first", "later")}
        for (kind, item), n in alike.items():
            if kind == "edge":
                sums["always"].note_start(*item[0], n * UNIT)
                sums["always"].note_end(*item[1], n * UNIT)
            elif kind == "place":
                last = float(item.verdict == YES)
                if item.guess == last:
                    sums["always"].note(item, last, n)
                    continue
                sums["later"].note(item, last, n)
                if item.guess is not None:
                    sums["first"].note(item, item.guess, n)
        return sums

    def count(self, new: BoundaryModel, runs: Iterable[tuple[tuple[Place, ...], int]], model: BoundaryModel | None) -> None:
        """Count the places of the model in runs by their posteriors of the round before."""
        for run, n in runs:
            for p, w in zip(run, model.posteriors(run) if model else (p.guess for p in run)):
                if w is not None and p.verdict == ASK:
                    new.note(p, w, n)

    def model(self, counted: BoundaryModel) -> BoundaryModel:
        """The model of what was counted, and of the fixed abbreviations."""
        out = self.blank()
        for c, (no, yes) in counted.ends.items():
            out.ends[c] = [no / UNIT, yes / UNIT]
        for name in ("starts", "goes_on", "goes_on_all"):
            getattr(out, name).update({key: n / UNIT for key, n in getattr(counted, name).items()})
        for w in ABBREVIATIONS:
            out.ends[(".", w)][0] += 4
        for w in self.at_places:
            out.ends[(".", out.left(w))][1] += 2
        return out


def fit(texts: Iterable[str], rounds: int = ROUNDS) -> BoundaryModel:
    """The model of some texts, in one process."""
    seen = Seen()
    for text in texts:
        pieces(text, seen)
    of: dict[str, Counter] = defaultdict(Counter)
    for kind, item, n in seen.items():
        of[kind][item] = n
    least, begins, bare = (at_least(n, seen.texts) for n in (KNOWN, BEGINS, BARE))
    known = [{w for w, n in of[side].items() if n >= least} for side in ("left", "right")]
    base = based((w if w in known[1] else shape(w), script(w), n) for w, n in of["right"].items())
    whole = {w for w, n in of["bare"].items() if n >= bare and n * 20 >= of["left"][w]}
    rules = Rules(*known, whole, set(of["left"]), {w for w, n in of["begin"].items() if n >= begins}, base)
    alike = rules.alike((kind, item, n) for kind in ("run", "edge") for item, n in of[kind].items())
    fixed = rules.fixed(alike)
    runs = [(item, n) for (kind, item), n in alike.items() if kind == "run"]
    model = None
    for _ in range(rounds):
        counted = rules.start(fixed, model)
        rules.count(counted, runs, model)
        model = rules.model(counted)
    return model


def packed(key) -> str:
    return json.dumps(key, ensure_ascii=False)


def unpacked(key: str):
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    return tuples(json.loads(key))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, 50_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


COUNTS = pa.schema([("kind", pa.string()), ("item", pa.string()), ("n", pa.int64())])
SUM_ROWS = "t string, key string, no bigint, yes bigint"
SUMS = pa.schema([("t", pa.string()), ("key", pa.string()), ("no", pa.int64()), ("yes", pa.int64())])


def read(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text in pieces (kind null), and what the texts teach (kind, item, n), in one pass; equal items may come several times.

    The pieces are kept in the shared folder of checkpoints, so that no text is read twice.
    """
    pairs = spread(df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    ints, strings = pa.list_(pa.int32()), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys = Seen(), pa.null()
        schema = lambda: pa.schema([("key", keys), ("starts", ints), ("ends", ints), ("runs", strings), *COUNTS])

        def told() -> Iterator[pa.RecordBatch]:
            for b in batches_of(seen.items(), COUNTS):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(b), f.type) for f in list(schema())[:4]] + b.columns, schema=schema())

        for batch in batches:
            keys = batch.column(0).type
            for part in (batch.slice(a, 1_000) for a in range(0, len(batch), 1_000)):
                got = [pieces(t, seen) for t in part.column(1).to_pylist()]
                lists = [pa.array([g[i] for g in got], t) for i, t in enumerate((ints, ints, strings))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists] + [pa.nulls(len(part), f.type) for f in COUNTS], schema=schema())
                if seen.settle() > 400_000:  # the counts of a task stay bounded
                    yield from told()
                    seen = Seen()
        if seen.texts:
            yield from told()

    kind = df.schema[key].dataType.simpleString()
    return cut(pairs.mapInArrow(run, f"key {kind}, starts array<int>, ends array<int>, runs array<string>, kind string, item string, n bigint"))


def fit_table(df: DataFrame, text: str, rounds: int = ROUNDS) -> BoundaryModel:
    """The model of all texts of a table, the same as that of fit."""
    return fit_read(read(df.select(F.lit(0).alias("key"), text), "key", text), rounds)


def fit_read(told: DataFrame, rounds: int = ROUNDS) -> BoundaryModel:
    """The model of what read gives; the driver gets the words that count and the sums of each round."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, rows = sent.value[0], rows_of(batches)
        while part := list(islice(rows, 200_000)):
            alike = rules.alike(part)
            yield from batches_of((("run", packed(item), n, 0) for (kind, item), n in alike.items() if kind == "run"), SUMS)
            for when, sums in rules.fixed(alike).items():
                yield from batches_of(((f"{when} {t}", packed(key), no, yes) for t, key, no, yes in sums.sums()), SUMS)

    counts = told.where("kind IS NOT NULL").select("kind", "item", "n")
    said = cut(counts.where("kind NOT IN ('run', 'edge')").groupBy("kind", "item").agg(F.sum("n").alias("n")))
    of = lambda kind: said.where(F.col("kind") == kind).select(F.col("item").alias("word"), "n")
    texts = of("text").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least, begins, bare = (at_least(n, texts) for n in (KNOWN, BEGINS, BARE))
    names = lambda rows: set(rows.select("word").toArrow()["word"].to_pylist())
    known = names(of("right").where(F.col("n") >= least))
    whole = names(of("bare").join(of("left").withColumnRenamed("n", "left"), "word").where(f"n >= {bare} AND n * 20 >= left"))

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for w, n in rows_of(batches):
            got[w if w in known else shape(w), script(w)] += n
        yield from batches_of(((*key, n) for key, n in got.items()), pa.schema([("word", pa.string()), ("script", pa.string()), ("n", pa.int64())]))

    right = of("right").mapInArrow(bases, "word string, script string, n bigint").groupBy("word", "script").agg(F.sum("n").alias("n"))
    rules = Rules(names(of("left").where(F.col("n") >= least)), known, whole, whole, names(of("begin").where(F.col("n") >= begins)), based(rows_of(right.toArrow().to_batches())))
    context, model = told.sparkSession.sparkContext, None
    sent = context.broadcast((rules, None))
    summed = lambda rows: rows.groupBy("t", "key").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    alike = cut(summed(counts.where("kind IN ('run', 'edge')").mapInArrow(reduced, SUM_ROWS)))
    fixed = {when: rules.blank() for when in ("always", "first", "later")}
    for t, key, no, yes in rows_of(alike.where("t <> 'run'").toArrow().to_batches()):
        when, table = t.split()
        fixed[when].add(table, unpacked(key), no, yes)
    runs = alike.where("t = 'run'").select("key", "no")
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            rules, model = sent.value
            counted = rules.blank()
            rules.count(counted, ((tuple(Place(*p) for p in json.loads(run)), n) for run, n in rows_of(batches)), model)
            yield from batches_of(((t, packed(key), no, yes) for t, key, no, yes in counted.sums()), SUMS)

        counted = rules.start(fixed, model)
        for t, key, no, yes in rows_of(summed(runs.mapInArrow(count, SUM_ROWS)).toArrow().to_batches()):
            counted.add(t, unpacked(key), no, yes)
        model = rules.model(counted)
        sent.unpersist()
        sent = context.broadcast((rules, frozen(model)))
    return model


#: A word of the running text without a period behind it.
BARE_WORD = re.compile(r"[^\W\d_]{3,}(?![\w.])")
THAI_END = re.compile(f"[{THAI}]")
HAN_END = re.compile(f"[{HAN}]")


def units(text: str | None, model: BoundaryModel) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, in code points."""
    if not text:
        return []
    starts, ends, runs = pieces(text)
    at, to = joined(np.array(starts, np.int32), np.array(ends, np.int32), [w for r in runs for w in model.decided(r)])[:2]
    return list(zip(at.tolist(), to.tolist()))


def joined(starts: np.ndarray, ends: np.ndarray, decided: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the units that pieces make, and whether each piece ends one; the last piece of a text always does."""
    ends_unit = ends >= 0
    ends = np.where(ends_unit, ends, ~ends)
    ends_unit[~ends_unit] = decided
    return starts[np.concatenate(([True], ends_unit[:-1]))] if len(starts) else starts, ends[ends_unit], ends_unit


def sample(df: DataFrame, key: str, text: str, docs: int) -> list[str]:
    """The texts of least hashed key, docs at most; equal whatever the partitioning, also where a key is repeated.

    The share of hashes that is asked for comes from the number of rows, so the driver gets about docs texts from a table of any
    size; a table of up to docs rows comes whole.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(text).alias("t"))
    n = df.count()
    if n > docs:
        share = min(1.0, (docs + 4 * math.sqrt(docs)) / n)
        rows = rows.where(F.col("h") < int(-(2**63) + share * 2**64 - 1) if share < 1 else F.lit(True))
    return [r["t"] for r in rows.orderBy("h", "k", "t").limit(docs).collect()]


def frozen(model: BoundaryModel) -> BoundaryModel:
    """The model without what only fitting needs, to be sent to the tasks."""
    model.ends, model.goes_on, model.goes_on_all, model.cache = dict(model.ends), dict(model.goes_on), dict(model.goes_on_all), {}
    return model


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", docs: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(key, sent_start, sent_end): the sentence units of each text by offsets in code points, the end exclusive.

    Null, empty and blank texts have no unit; repeated rows have theirs each; other columns are not read. The model is fitted on all
    texts, or on a sample of docs texts where a caller asks for one; every text is read once and segmented whole, without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    told = read(df, key, text)
    sent = df.sparkSession.sparkContext.broadcast(frozen(fit_read(told, rounds) if docs is None else fit(sample(df, key, text, docs), rounds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in batches:
            starts, ends, runs = (batch.column(i).flatten() for i in (1, 2, 3))
            coded = runs.dictionary_encode()
            values = coded.dictionary.to_pylist()
            for r in values:
                if r not in known:
                    known[r] = model.decided(r)
            of = [known[r] for r in values]
            at, to, ends_unit = joined(starts.to_numpy(), ends.to_numpy(), [w for i in coded.indices.to_pylist() for w in of[i]])
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(1)).to_numpy())[ends_unit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(at), pa.array(to)], ["key", "sent_start", "sent_end"])
            if len(known) > 200_000:
                known = {}

    found = told.where("kind IS NULL").select("key", "starts", "ends", "runs")
    return found.mapInArrow(run, f"key {kind}, sent_start int, sent_end int").withColumnRenamed("key", key)
