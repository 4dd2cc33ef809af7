"""Personal information in free text: candidate spans, boosted trees, calibrated thresholds.

Generators of high recall propose overlapping spans for each type of item;
boosted trees judge every span by its format and the words around it; the
probabilities are calibrated on messages of other wordings, and per type the
threshold with the best F1 there decides. Of overlapping spans the more probable
one stays. A batch of texts is one long text to the generators, and features come
from counts up to each character and token, so no span is looked at by itself.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Trees
from .pii_sample import FAMILY, GIVEN, TYPES, sample

#: Labelled messages the classifier is fitted on, and those it is calibrated on.
FIT_MESSAGES, CALIBRATE_MESSAGES, SEED = 10_000, 2000, 7
#: Texts, and characters of texts, that are looked at together.
BATCH, BATCH_CHARS = 1000, 1_000_000
#: Parts texts in a batch; nothing matches it.
BETWEEN = "\x00\x00"

# ---- generators ----
_USER, _LABEL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+", r"[A-Za-z0-9-]+"
_DOT = r"(?:\.|\s?[\(\[]\s?dot\s?[\)\]]\s?|\s+dot\s+)"
#: With a sign for "at", or with the word; tried at every word, so that they may overlap.
EMAILS = [
    re.compile(rf"(?<![\w.+%-])(?=({_USER}(?:\s?@\s?|\s?[\(\[]\s?at\s?[\)\]]\s?){_LABEL}(?:{_DOT}{_LABEL})+))", re.IGNORECASE),
    re.compile(rf"(?<![\w.+%-])(?=({_USER}\s+at\s+{_LABEL}(?:\s?[\(\[]\s?dot\s?[\)\]]\s?{_LABEL}|\s+dot\s+{_LABEL})+))", re.IGNORECASE),
    re.compile(rf"(?<![\w.+%-])(?=({_USER}\s+at\s+{_LABEL}(?:\.{_LABEL})++)(?!\s?@))", re.IGNORECASE),
]
PHONE = re.compile(r"(?<![\w.#/@-])(?:\+\s?|00\s)?(?:\(\+?\d{1,4}\)|\d)(?:[\s.()/-]{0,2}\d){6,}(?:\s*(?:ext\.?|extn\.?|x)\s*\d{1,5})?(?![\w/])", re.IGNORECASE)
ID = re.compile(r"(?<![\w.#/@-])(?:[A-Z]{1,6}-?\d{4,}[A-Z]?\d?|[A-Z]{2} \d{2} \d{2} \d{2} [A-Z]|\d{2,6}(?:[ .-]\d{2,6}){1,4}|\d{8,}[A-Z]?)(?![\w/])")
# ---- fixed values: words no postal address goes on with ----
_STOP = "the|is|are|was|were|has|have|had|be|been|and|or|but|if|when|while|please|thanks|thank|it|its|this|that|these|i|you|we|he|she|they|my|our|your|after|before|since|until|with|for|from|to|by|on|not|no|there|would|should|could|can|cannot|will|do|does|did|call|write|why|what|then|than|as|so|because|about|every|again|still|too|also"
_BEGIN = r"(?:(?:flat|house|plot|apt|apartment|unit|door|villa)\s?(?:no\.?\s?)?\d{1,4}[A-Za-z]?|p\.?\s?o\.?\s?box\s\d{1,6}|\d{1,5}[A-Za-z]?(?:/\d{1,3})?)"
#: Tried at every place where an address may begin, so that they may overlap; it has 40 words at most, and ends before a word of the list above.
ADDRESS = re.compile(
    rf"(?<![\w#/.-])(?=({_BEGIN}(?:,?[ \n](?!(?:{_STOP})\b)(?:[^\W\d_][\w.'’-]*|-|\d{{1,4}}[A-Za-z]?\b(?!\d)))(?:,?[ \n](?!(?:{_STOP})\b)(?:[^\W\d_][\w'’-]*\.?|-|\d[\w-]*)){{0,40}}))",
    re.IGNORECASE,
)
CUT = re.compile(r"[,\n]|[.;] |\s-\s|(?<=[ -])\d{5,6}(?!\d)|\d{3} \d{3}(?!\d)|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b")
TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+|[#@&/<>(\x00]")
# ---- fixed values: words and forms the features know ----
STREET = frozenset("flat house plot box apartments apartment apt st street marg nagar lane rd road ave avenue sector cross drive close enclave colony way square rue strasse straße".split())
TITLES = frozenset("dr prof professor mr ms mrs miss".split())
CUES = frozenset("name is am regards sincerely wishes yours thanks cheers cc with by ask contact dear signed from of hi hello to and meet tell copy thank i'm wish truly faithfully this".split()) | TITLES
BEGINS = ("flat", "apt", "apartment", "unit", "door", "house", "villa", "plot", "p", "po")
ENDING = re.compile(r"(?:\d{5,6}|\d{3} \d{3}|[A-Z]\d[A-Z\d]? \d[A-Z]{2})$")
MORE = re.compile(r"(?:\s*-)?\s*\d{3}|,? [A-Z]?[a-z]+ \d{5,6}|\n[A-Z]?[a-z]+ \d{5,6}")
BREAKS = re.compile(r"$|\x00|[.;,!]?(?:\s|$)| -")
KNOWN_NAMES = frozenset(x.lower() for x in GIVEN + FAMILY)
NEARBY = (
    CUES,
    frozenset("mail email e-mail write reach address reply contact mailbox account".split()),
    frozenset("call phone telephone tel mobile cell fax text ring dial number whatsapp line hotline contact landline office reach".split()),
    frozenset("passport id identity aadhaar card tax ssn social security licence license national pan permit insurance registration enrolment enrolled registered voter document visa driving residence".split()),
    frozenset("address live lives stay home post deliver send ship shipped visit located moved office residence parcel letter parents flat house at come find family".split()),
)
THINGS = frozenset("hall house street road park tower group lab laboratory team campus network node app tool cluster library institute university college centre center school hostel model dataset portal server project award workshop conference journal report guide handbook river lake bridge station hotel club bank foundation page site film theorem method block building wing museum".split())
#: A public tokenizer whose vocabulary tells words of every day; only the driver reads it.
DICTIONARY = "/opt/tokenizers/byte_bpe_50k.json"


def dictionary(path: str = DICTIONARY) -> frozenset[str]:
    """Lower-case words that a tokenizer has a token of its own for; a missing file gives none."""
    if not os.path.exists(path):
        return frozenset()
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    return frozenset(t[1:] for t in tokens if len(t) > 2 and t[0] == "\u0120" and t[1:].isalpha() and t[1:].islower() and t.isascii() is False and t[1:].isascii())




class Batch:
    """Texts joined to one, its tokens, and the candidate spans in it."""

    def __init__(self, texts: list[str], common: frozenset[str], codes: dict[str, int]) -> None:
        # codes tell context words; common ones are no names
        self.text = BETWEEN + BETWEEN.join(texts) + BETWEEN
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + len(BETWEEN))[:-1]]) + len(BETWEEN)
        found = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(self.text)]
        self.at, self.end = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
        table: dict[str, tuple] = {}
        rows = []
        for _, _, w in found:
            got = table.get(w)
            if got is None:
                low, first = w.lower(), w[0]
                alpha = first.isalpha()
                known = low in common
                code = codes.get("0" if first.isdigit() else low, codes["?"] if known else codes["??"])
                near = sum((low in words) << k for k, words in enumerate(NEARBY))
                got = table[w] = (code, alpha, first.isdigit(), len(w), first.isupper(), known, low in STREET, low in TITLES, low in CUES, low == "dot", low in KNOWN_NAMES, BEGINS.index(low) if low in BEGINS else -1, first == "\x00", near, low in THINGS)
            rows.append(got)
        columns = np.array(rows, np.int32).reshape(len(rows), 15).T
        self.code, self.length, self.begin, self.near = columns[0], columns[3], columns[11], columns[13]
        self.alpha, self.digit, self.upper, self.known, self.street, self.title, self.cue, self.dot, self.listed, self.edge, self.thing = (columns[i].astype(bool) for i in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14))

    def candidates(self) -> np.ndarray:
        """Proposed spans as rows (type, shape, start, end) in the joined text; they overlap freely."""
        text, out = self.text, []
        low = text.lower()
        for k, pattern in enumerate(EMAILS):
            if k == 0 or " at " in low or "\tat" in low or "\nat" in low:
                out += [(1, k, *m.span(1)) for m in pattern.finditer(text)]
        out += [(2, 0, *m.span()) for m in PHONE.finditer(text)]
        out += [(3, 0, *m.span()) for m in ID.finditer(text)]
        for m in ADDRESS.finditer(text):
            a, span = m.start(), m.group(1).rstrip(" \n-.,;")
            if not any(map(str.isalpha, span[1:])):
                continue
            out.append((4, 0, a, a + len(span)))
            for cut in CUT.finditer(span):  # an address may end at any break and at any postal number
                b = cut.end() if cut.group()[-1].isalnum() else len(span[: cut.start()].rstrip(" \n-.,;"))
                if b > 3:
                    out.append((4, 1 if b < cut.end() else 2, a, a + b))
        spans = np.array(sorted(set(out)), np.int64).reshape(-1, 4)
        return np.concatenate([self._names(), spans])

    def _names(self) -> np.ndarray:
        """Runs of words and initials in the shapes of a name, from every capitalised word and every word after a cue."""
        n = len(self.at)
        if n < 2:
            return np.zeros((0, 4), np.int64)
        gap = np.zeros(n, np.int8)  # what follows a token: 1 blank, 2 comma, 3 dot, 4 dot and blank
        width = np.append(self.at[1:], len(self.text)) - self.end
        chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        one, two = chars[np.minimum(self.end, len(chars) - 1)], chars[np.minimum(self.end + 1, len(chars) - 1)]
        gap[(width == 1) & (one == 32)] = 1
        gap[((width == 1) & (one == 44)) | ((width == 2) & (one == 44) & (two == 32))] = 2
        gap[(width == 1) & (one == 46)] = 3
        gap[(width == 2) & (one == 46) & (two == 32)] = 4
        dotted = (width > 0) & (one == 46)
        word, initial = self.alpha & (self.length > 1), self.alpha & (self.length == 1)
        before = chars[np.maximum(self.at - 1, 0)]
        free = ~np.isin(before, np.frombuffer("@#+.'’-_".encode("utf-32-le"), np.uint32)) | (before == 46) & np.roll(self.title, 1)
        start = (self.alpha & free & (self.upper | np.roll(self.cue, 1) | np.roll(self.edge, 1))) & ~self.digit
        at = lambda x, k: np.append(x[k:], np.zeros(k, x.dtype)) if k else x
        W, I, G, D = (lambda k: at(word, k)), (lambda k: at(initial, k)), (lambda k: at(gap, k)), (lambda k: at(dotted, k))  # noqa: E731, E741
        dots = lambda k: (G(k) == 3) | (G(k) == 4)
        shapes = [
            (W(0), 0, False), (W(0) & (G(0) == 1) & W(1), 1, False), (I(0) & dots(0) & W(1), 1, False), (I(0) & dots(0) & I(1) & dots(1) & W(2), 2, False), (W(0) & (G(0) == 2) & W(1), 1, False),
            (W(0) & (G(0) == 2) & I(1) & D(1), 1, True), (W(0) & (G(0) == 1) & I(1) & D(1), 1, True), (W(0) & (G(0) == 1) & I(1) & dots(1) & W(2), 2, False), (W(0) & (G(0) == 1) & W(1) & (G(1) == 1) & W(2), 2, False),
            (W(0) & (G(0) == 1) & W(1) & (G(1) == 1) & W(2) & (G(2) == 1) & W(3), 3, False), (W(0) & (G(0) == 1) & I(1), 1, False), (I(0) & (G(0) == 1) & W(1), 1, False), (W(0) & (G(0) == 2) & I(1), 1, False),
        ]
        strange = np.concatenate([[0], np.cumsum(self.alpha & ~self.known & ~initial)])
        capital = np.concatenate([[0], np.cumsum(self.upper)])
        out = []
        for k, (fits, more, dot) in enumerate(shapes):
            i = np.flatnonzero(fits & start)
            j = np.minimum(i + more, n - 1)
            # words of every day are no name, unless several are capitalised
            odd = (strange[j + 1] > strange[i]) | ((capital[j + 1] - capital[i]) == (j - i + 1)) & (j > i)
            odd &= self.upper[i] == self.upper[j]
            i, j = i[odd], j[odd]
            out.append(np.column_stack([np.zeros_like(i), np.full_like(i, k), self.at[i], self.end[j] + dot]))
        return np.concatenate(out).astype(np.int64)


class Model:
    """The fitted trees, the weights of context words, and the thresholds per type."""

    def __init__(self) -> None:
        self.trees = Trees(rounds=90)
        self.common: frozenset[str] = frozenset()
        self.codes: dict[str, int] = {}
        self.context: list[tuple[np.ndarray, np.ndarray]] = []
        self.thresholds = np.full(len(TYPES), 0.5)

    def batch(self, texts: list[str]) -> Batch:
        return Batch(texts, self.common, self.codes)

    def _around(self, b: Batch, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of one and two tokens before and after each span, with the tokens' places."""
        n = len(self.codes) + 2
        kind = spans[:, 0]
        i, j = np.searchsorted(b.at, spans[:, 2], "left"), np.searchsorted(b.at, spans[:, 3], "left")  # first token inside, first behind
        code = lambda k: b.code[np.clip(k, 0, len(b.code) - 1)].astype(np.int64)
        one, two, next_, after = code(i - 1), code(i - 2), code(j), code(j + 1)
        return np.stack([kind * n + one, (kind * n + one) * n + two, kind * n + next_, (kind * n + next_) * n + after], 1), i, j

    def features(self, b: Batch, spans: np.ndarray) -> np.ndarray:
        keys, i, j = self._around(b, spans)
        around = []
        for c, (known, weight) in enumerate(self.context):
            at = np.minimum(np.searchsorted(known, keys[:, c]), max(0, len(known) - 1))
            around.append(np.where(known[at] == keys[:, c], weight[at], 0.0) if len(known) else np.zeros(len(keys)))
        chars = np.frombuffer(b.text.encode("utf-32-le"), np.uint32)
        a, e = spans[:, 2], spans[:, 3]
        upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        over = lambda c: c[e] - c[a]
        digits = over(upto((chars >= 48) & (chars <= 57)))
        letter = np.zeros(len(chars), np.int64)
        upper = np.zeros(len(chars), np.int64)
        for t in np.flatnonzero(b.alpha):
            letter[b.at[t] : b.end[t]] = 1
        capital = np.fromiter((c.isupper() for c in b.text), bool, len(b.text))
        upper[capital] = 1
        letters, uppers = over(upto(letter)), over(upto(upper))
        token = lambda mask: (lambda c: c[j] - c[i])(upto(mask))
        words, groups = token(b.alpha), token(b.digit)
        known, street, listed, dot = token(b.alpha & b.known), token(b.street), token(b.listed), token(b.dot)
        places = np.flatnonzero(b.digit)
        length = np.append(b.length[places], [0, 0, 0])
        first = np.searchsorted(places, i)
        size = lambda k: np.where(groups > k, length[np.minimum(first + k, len(length) - 1)], 0)
        last = np.where(groups > 0, length[np.clip(first + groups - 1, 0, len(length) - 1)], 0)
        spot = lambda ch: over(upto(chars == ord(ch)))
        clip = lambda x, k: x[np.clip(k, 0, len(x) - 1)]
        word_at = np.flatnonzero(b.alpha)
        first_word = clip(word_at, np.searchsorted(word_at, i)) if len(word_at) else np.zeros(len(i), np.int64)
        last_word = clip(word_at, np.searchsorted(word_at, j) - 1) if len(word_at) else np.zeros(len(i), np.int64)
        has = words > 0
        before, behind = chars[np.maximum(a - 1, 0)], chars[np.minimum(e, len(chars) - 1)]
        address = spans[:, 0] == 4
        ends, more, breaks = np.zeros(len(a), bool), np.zeros(len(a), bool), np.zeros(len(a), bool)
        for k in np.flatnonzero(address).tolist():
            s, t = int(a[k]), int(e[k])
            ends[k], more[k], breaks[k] = bool(ENDING.search(b.text, max(s, t - 8), t)), bool(MORE.match(b.text, t)), bool(BREAKS.match(b.text, t))
        near = []
        sofar = np.arange(len(b.at)) - np.maximum.accumulate(np.where(b.edge, np.arange(len(b.at)), 0))  # tokens since the text began
        back = np.minimum(5, clip(sofar, np.maximum(i - 1, 0)))
        for k in range(len(NEARBY)):
            c = upto((b.near >> k) & 1)
            near.append(c[i] - c[np.maximum(i - back, 0)])
        new = np.isin(before, (0, 10)) | np.isin(chars[np.maximum(a - 2, 0)], (46, 59, 33, 63)) & (before == 32)
        return np.column_stack(
            [
                spans[:, 0], spans[:, 1], e - a, digits, letters, uppers / np.maximum(1, letters), words, groups, size(0), size(1), size(2), last, chars[a] == 43, chars[a] == 48, spot("("), spot("/"), spot("-"), spot("."), spot(","), spot("\n"), spot("@"), dot, known, words - known, street, listed,
                has & clip(b.upper, first_word), has & clip(b.upper, last_word), has & (uppers == letters), uppers == 0, clip(b.title, i - 1), clip(b.upper, i - 1) & clip(b.alpha, i - 1), clip(b.upper, j) & clip(b.alpha, j), has & clip(b.known, first_word), has & clip(b.known, last_word),
                before, behind, *around, clip(b.begin, i), ends, more, breaks, new, clip(b.edge, i - 1), clip(b.edge, j), *near, clip(b.thing, j), clip(b.thing, j + 1),
            ]
        ).astype(np.float64)

    def fit(self, messages: list, held_out: list) -> Model:
        inside = Counter()
        for text, items in messages:
            rest = list(text)
            for _, a, b in items:
                rest[a:b] = [" "] * (b - a)
            inside.update(w.lower() for w in set(re.findall(r"[^\W\d_]+", "".join(rest))))
        own = {w for w, n in inside.items() if n >= 3}
        # only frequent words tell a context by themselves, so that the trees also learn what unfamiliar words of every day around a span mean
        often = {w for w, n in inside.items() if n >= max(3, len(messages) // 100)}
        self.common = frozenset((own | dictionary()) - KNOWN_NAMES)
        self.codes = {w: k for k, w in enumerate(["?", "??", "0", "\x00", *"#@&/<>(", *sorted(often - KNOWN_NAMES)])}
        # context weights come from one half, the trees from the other, so that the trees see weights as rough as in new texts
        b, spans, y, _ = self._labelled(messages[::2])
        keys, _, _ = self._around(b, spans)
        kinds = spans[:, 0]
        prior = np.array([(y[kinds == k].sum() + 1) / ((kinds == k).sum() + 2) for k in range(len(TYPES))])
        self.context = []
        for c in range(keys.shape[1]):
            known, owner = np.unique(keys[:, c], return_inverse=True)
            n, right = np.bincount(owner), np.bincount(owner, y)
            p = prior[kinds[np.unique(keys[:, c], return_index=True)[1]]]
            often = n >= 3
            self.context.append((known[often], np.log((right + 10 * p) / (n - right + 10 * (1 - p)))[often]))
        b, spans, y, _ = self._labelled(messages[1::2])
        self.trees.fit(self.features(b, spans), y)
        b, spans, y, places = self._labelled(held_out)
        x = self.features(b, spans)
        self.trees.calibrate(x, y)
        p = self.trees.probability(x)
        total, true = Counter(), Counter()
        for q, hit, place in zip(p.tolist(), y.tolist(), places):
            total[place] += q
            true[place] = max(true[place], hit)
        for k in range(len(TYPES)):
            own = [(q, true[place]) for place, q in total.items() if place[0] == k]
            score, hit = np.array([x[0] for x in own]), np.array([x[1] for x in own])
            best = (-1.0, 0.0, 0.5)
            for t in np.arange(0.25, 0.81, 0.05):
                f1 = 2 * hit[score >= t].sum() / max(1, (score >= t).sum() + hit.sum())
                best = max(best, (round(float(f1), 3), -abs(float(t) - 0.5), float(t)))
            self.thresholds[k] = best[-1]
        return self

    def _labelled(self, messages: list) -> tuple[Batch, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """The messages as a batch, its candidates, their labels, and the place (type, start) of each."""
        b = self.batch([text for text, _ in messages])
        truth = {(TYPES.index(k), int(s) + x, int(s) + y) for s, (_, items) in zip(b.starts, messages) for k, x, y in items}
        spans = b.candidates()
        y = np.array([(k, s, e) in truth for k, _, s, e in spans.tolist()], np.float64)
        return b, spans, y, [(k, s) for k, _, s, _ in spans.tolist()]

    def items(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """Per text the items (type, start, end, probability) in order, without overlaps.

        Spans of one type that begin at the same place exclude each other, so their
        probabilities add up to that of an item there; the likeliest of them is it.
        """
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        live = [k for k, t in enumerate(texts) if t]
        if not live:
            return out
        # the character that parts texts can stand for itself as any other that is no word
        b = self.batch([texts[k].replace("\x00", "\x01") for k in live])
        spans = b.candidates()
        if not len(spans):
            return out
        p = self.trees.probability(self.features(b, spans))
        worth = np.flatnonzero(p > 0.004)
        places: dict[tuple[int, int], dict[int, float]] = {}
        for (k, _, s, e), q in zip(spans[worth].tolist(), p[worth].tolist()):
            ends = places.setdefault((s, k), {})
            ends[e] = max(q, ends.get(e, 0.0))
        likely = []
        for (s, k), ends in places.items():
            total = min(1.0, sum(ends.values()))
            if total >= self.thresholds[k]:
                likely.append((total, k, s, max(ends, key=lambda e: (ends[e], e))))
        owner = np.searchsorted(b.starts, [x[2] for x in likely], "right") - 1
        kept: list[list[tuple[int, int, int, float]]] = [[] for _ in live]
        for (q, k, s, e), o in sorted(zip(likely, owner.tolist()), key=lambda c: (-round(c[0][0], 2), -(c[0][3] - c[0][2]), c[0][2], c[0][1])):
            if all(e <= x[1] or s >= x[2] for x in kept[o]):
                kept[o].append((k, s, e, q))
        for o, found in enumerate(kept):
            base = int(b.starts[o])
            out[live[o]] = sorted(((k, s - base, e - base, q) for k, s, e, q in found), key=lambda x: x[1])
        return out


@lru_cache(maxsize=1)
def model() -> Model:
    """Fitted once per driver on the bounded labelled sample, calibrated on wordings it has not seen."""
    return Model().fit(sample(FIT_MESSAGES, SEED), sample(CALIBRATE_MESSAGES, SEED + 1, held_out=True))


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of at most BATCH texts and about BATCH_CHARS characters."""
    first = held = 0
    for k, t in enumerate(texts):
        size = len(t) if t else 0
        if k > first and (k - first >= BATCH or held + size > BATCH_CHARS):
            yield first, k
            first, held = k, 0
        held += size
    if len(texts) > first:
        yield first, len(texts)


def personal_items(messages: DataFrame, key: str = "suggestion_id", text: str = "message") -> DataFrame:
    """Every personal item: key, pii_type, start_pos, end_pos (1-based characters, both included), probability.

    A row loaded twice counts once. Null and empty messages have no items; texts of
    any length are searched whole; several texts under one key are each searched;
    an empty table gives no rows. Characters are Unicode code points. A name has at
    most four words and an address 40.
    """
    fitted = model()
    key_type = messages.schema[key].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["k"].tolist(), batch["t"].tolist()
            for a, b in _parts(texts):
                rows = [(k, TYPES[t], s + 1, e, q) for k, items in zip(keys[a:b], fitted.items(texts[a:b])) for t, s, e, q in items]
                yield pd.DataFrame(rows, columns=["key", "pii_type", "start_pos", "end_pos", "probability"])

    rows = messages.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0).distinct()
    found = rows.mapInPandas(find, f"key {key_type}, pii_type string, start_pos int, end_pos int, probability double")
    return found.withColumnRenamed("key", key)


def redacted(messages: DataFrame, key: str = "suggestion_id", text: str = "message") -> DataFrame:
    """Every message (key, text) with each item replaced by [TYPE] and all else unchanged; null and empty messages stay. A row loaded twice counts once."""
    fitted = model()
    key_type = messages.schema[key].dataType.simpleString()

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["t"].tolist()]
            out = []
            for a, b in _parts(texts):
                for t, items in zip(texts[a:b], fitted.items(texts[a:b])):
                    for k, s, e, _ in reversed(items):
                        t = f"{t[:s]}[{TYPES[k].upper()}]{t[e:]}"
                    out.append(t)
            yield pd.DataFrame({"k": batch["k"], "t": out})

    rows = messages.select(F.col(key).alias("k"), F.col(text).alias("t")).distinct()
    return rows.mapInPandas(replace, f"k {key_type}, t string").select(F.col("k").alias(key), F.col("t").alias(text))
