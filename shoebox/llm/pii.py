"""Personal data in whole texts: exact patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The patterns (email, ip, card, phone) give the base spans. The tagger is trained in numpy on windows around them: a bounded sample of
labelled windows (``PER_KIND`` for each kind, and as many without a span), and copies of these with the span's marks
respelt (" at " for "@", other separators, no plus), so that it finds what the patterns are too strict for.

A plausible span of any kind holds a digit, an "@" or a spelt-out "at", so only the surroundings of those are read: windows of ``WIDTH``
characters, each overlapping the next by half. A span that every window cuts is read again in wider windows around it, until one holds it whole.
Every window is decoded by Viterbi; the spans found in all of a text's windows, scored by their CRF posterior, are then reconciled at once: those of the greatest total score that do not overlap. Added spans must be
sure (``SURE``), plausible for their kind, and clear of every base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.common import map_arrow, materialize, sample_per_key

KINDS = ("email", "ip", "card", "phone")
WIDTH, PER_KIND, SURE = 96, 400, 0.9
HIDDEN, EMBED, STEPS, BATCH = 16, 8, 240, 48
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

# The base patterns of the contract. A possessive first run and the look-behind match what the plain pattern
# does, in linear time; an email is found from its "@", its local part read backwards.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")
_TRIGGER = re.compile("[0-9@]")
_AT = r"[(\[ ]at[)\] ]"
_SPELT = re.compile("[0-9@]|" + _AT)
AT_ONCE = 4096 * 96  # characters of windows read together

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that pass its test, without retries, by kind and start."""
    out: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((0, start, end))
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m.group())) <= 15] if "+" in text else []
    return out


def windows(text: str, width: int = WIDTH) -> list[int]:
    """Starts of the windows that cover the surroundings of every digit, "@" and spelt-out "at", overlapping by half."""
    half = width // 2
    out: list[int] = []
    begin = end = None
    for m in _SPELT.finditer(text):
        at = m.start()
        if end is None or at - half > end:
            if end is not None:
                out += range(begin, max(begin + 1, end - half), half)
            begin = max(0, at - half)
        end = at + half
    if end is not None:
        out += range(begin, max(begin + 1, end - half), half)
    return out


def char_ids(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """A row of character classes for each window; 0 fills up."""
    out = np.zeros((len(texts), width), dtype=np.int64)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out[i, : len(codes)] = _CLASS[np.minimum(codes, 128)]
    return out


def _classes() -> np.ndarray:
    """Digits are one class, vowels and other small letters, capitals, every mark of its own; beyond ASCII one."""
    marks = {c: i for i, c in enumerate("@.+-()_% \n,:;/'", start=8)}
    kind = [marks.get(c, 1 if c.isdigit() else 2 if c in "aeiou" else 3 if c.islower() else 4 if c.isupper() else 5) for c in map(chr, range(128))]
    return np.array([*kind, 6])


_CLASS = _classes()
VOCABULARY = 8 + 15


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _allowed() -> np.ndarray:
    """0 where one tag may follow another, else a large penalty: an inside needs its kind before it."""
    block = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        block[:, inside] = -1e4
        block[[inside - 1, inside], inside] = 0
    return block


class Tagger:
    """Weights and passes of the network. ``w`` holds all arrays by name."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.25, shape)
        self.w = {"embed": draw(VOCABULARY, EMBED), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for side in ("left", "right"):
            self.w |= {f"{side}_x": draw(EMBED, 4 * HIDDEN), f"{side}_h": draw(HIDDEN, 4 * HIDDEN), f"{side}_b": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    # the LSTM: input, forget and output gates, then the candidate
    def _read(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        wh = self.w[f"{side}_h"]
        z = x @ self.w[f"{side}_x"] + self.w[f"{side}_b"]
        n, width = x.shape[:2]
        h, c, tape = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), []
        out = np.empty((n, width, HIDDEN))
        for t in range(width) if side == "left" else range(width - 1, -1, -1):
            a = z[:, t] + h @ wh
            gates, new = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            was_h, was_c = h, c
            c = f * c + i * new
            bent = np.tanh(c)
            h = o * bent
            out[:, t] = h
            tape.append((t, i, f, o, new, was_h, was_c, bent))
        return out, tape

    def _unread(self, x: np.ndarray, side: str, tape: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        wh = self.w[f"{side}_h"]
        dz = np.empty((*x.shape[:2], 4 * HIDDEN))
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        g_h = np.zeros_like(wh)
        for t, i, f, o, new, was_h, was_c, bent in reversed(tape):
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - bent**2)
            da = np.hstack([dc * new * i * (1 - i), dc * was_c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - new**2)])
            dz[:, t] = da
            g_h += was_h.T @ da
            dh, dc = da @ wh.T, dc * f
        grads[f"{side}_h"], grads[f"{side}_b"] = g_h, dz.sum(axis=(0, 1))
        grads[f"{side}_x"] = np.einsum("nte,ntg->eg", x, dz)
        return dz @ self.w[f"{side}_x"].T

    def emissions(self, ids: np.ndarray):
        x = self.w["embed"][ids]
        left, tape_l = self._read(x, "left")
        right, tape_r = self._read(x, "right")
        both = np.concatenate([left, right], axis=2)
        return both @ self.w["out"] + self.w["out_b"], (x, both, tape_l, tape_r)

    # the CRF
    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        """A window may begin inside a span, so every tag may come first."""
        return self.w["step"] + _allowed(), self.w["start"]

    def marginals(self, e: np.ndarray):
        """Forward and backward sums, and the chance of each tag at each place."""
        step, start = self._steps()
        n, width, _ = e.shape
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, width):
            alpha[:, t] = e[:, t] + _logsum(alpha[:, t - 1, :, None] + step, 1)
        for t in range(width - 2, -1, -1):
            beta[:, t] = _logsum(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _logsum(alpha[:, -1], 1)
        return alpha, beta, total, np.exp(alpha + beta - total[:, None, None])

    def decode(self, e: np.ndarray) -> np.ndarray:
        step, start = self._steps()
        n, width, _ = e.shape
        best, back = start + e[:, 0], np.empty((n, width, TAGS), dtype=np.int8)
        for t in range(1, width):
            through = best[:, :, None] + step
            back[:, t] = through.argmax(axis=1)
            best = through.max(axis=1) + e[:, t]
        tags = np.empty((n, width), dtype=np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tag rows, and its gradient by every array."""
        e, (x, both, tape_l, tape_r) = self.emissions(ids)
        step, start = self._steps()
        alpha, beta, total, chance = self.marginals(e)
        n, width, _ = e.shape
        rows = np.arange(n)
        gold = start[tags[:, 0]] + e[rows[:, None], np.arange(width), tags].sum(axis=1) + step[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_e = chance.copy()
        d_e[rows[:, None], np.arange(width), tags] -= 1
        d_step = np.zeros_like(step)
        for t in range(1, width):
            d_step += np.exp(alpha[:, t - 1, :, None] + step + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(d_step, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        grads = {"step": d_step / n, "start": d_e[:, 0].sum(axis=0) / n}
        d_e /= n
        grads["out"], grads["out_b"] = np.einsum("nth,ntk->hk", both, d_e), d_e.sum(axis=(0, 1))
        d_both = d_e @ self.w["out"].T
        d_x = self._unread(x, "left", tape_l, d_both[:, :, :HIDDEN], grads) + self._unread(x, "right", tape_r, d_both[:, :, HIDDEN:], grads)
        grads["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(grads["embed"], ids, d_x)
        return float((total - gold).mean()), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over random batches."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        for s in range(1, steps + 1):
            rows = rng.choice(len(ids), min(batch, len(ids)), replace=False)
            value, grads = self.loss(ids[rows], tags[rows])
            losses.append(value)
            for k, g in grads.items():
                g = np.clip(g, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.98 * v[k] + 0.02 * g * g
                slow = min(1.0, 2 * (1 - s / (steps + 1)))
                self.w[k] = self.w[k] - rate * slow * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.98**s)) + 1e-8)
        return losses


def tag_row(length: int, spans: list[Span], at: int, width: int = WIDTH) -> list[int]:
    """Tags of the window at ``at``; a span it cuts is tagged as far as it shows, of overlapping spans only the first."""
    tags = [0] * width
    upto = 0
    for kind, start, end in sorted(spans, key=lambda s: s[1:]):
        if start < upto:
            continue
        upto = end
        for i in range(max(start, at), min(end, at + width, length)):
            tags[i - at] = 2 + 2 * kind
        if at <= start < at + width:
            tags[start - at] = 1 + 2 * kind
    return tags


def respelt(text: str, tags: list[int], rng: np.random.Generator, width: int = WIDTH) -> tuple[str, list[int]]:
    """The window with the marks inside its spans written in another way."""
    swaps = [
        {"@": rng.choice([" @ ", " at ", "(at)", " [at] "]), ".": rng.choice([".", " . ", " dot "])},
        {".": rng.choice([" . ", ". ", "-"])},
        {"-": rng.choice([".", "  ", "/"]), " ": rng.choice([".", "  ", "/"])},
        {"+": rng.choice(["", "00", "(+) "]), "-": rng.choice(["-", "/", " "]), " ": rng.choice([" ", "/", "."])},
    ]
    out, marks = [], []
    for c, t in zip(text, tags, strict=False):
        new = str(swaps[(t - 1) // 2].get(c, c)) if t else c
        for i, x in enumerate(new):
            out.append(x)
            marks.append(t if i == 0 or t == 0 else t + t % 2)
        if not new and t % 2:  # the first character went: the next one begins the span
            marks.append(None)
            out.append("")
    fixed, begin = [], None
    for x, t in zip(out, marks, strict=True):
        if t is None:
            begin = True
            continue
        if begin and t and t % 2 == 0:
            t -= 1
        begin = None
        fixed.append((x, t))
    fixed = fixed[:width]
    return "".join(x for x, _ in fixed), [t for _, t in fixed] + [0] * (width - len(fixed))


@dataclass
class Found:
    kind: int
    start: int
    end: int
    score: float


def window_spans(tagger: Tagger, texts: list[str], width: int = WIDTH) -> list[list[Found]]:
    """Decoded spans of each window, scored by the mean posterior of their tags."""
    out: list[list[Found]] = []
    lot = max(1, 512 * WIDTH // width)
    for at in range(0, len(texts), lot):
        part = texts[at : at + lot]
        e, _ = tagger.emissions(char_ids(part, width))
        tags = tagger.decode(e)
        some = np.flatnonzero(tags.any(axis=1))
        chance = np.zeros_like(e)
        if len(some):
            chance[some] = tagger.marginals(e[some])[3]
        for n, text in enumerate(part):
            found, i, row = [], 0, tags[n].tolist()
            while i < len(text):
                if row[i] % 2 == 0:
                    i += 1
                    continue
                j = i + 1
                while j < len(text) and row[j] == row[i] + 1:
                    j += 1
                found.append(Found((row[i] - 1) // 2, i, j, float(chance[n, np.arange(i, j), row[i:j]].mean())))
                i = j
            out.append(found)
    return out


def plausible(kind: int, text: str) -> bool:
    """What no span of the kind lacks, however it is spelt."""
    digits = _DIGITS.sub("", text)
    if kind == 0:
        return bool(re.search("@|" + _AT, text)) and bool(re.search(r"[A-Za-z0-9][^A-Za-z0-9].*[.]|dot", text)) and len(text) >= 6
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(map(_byte, parts))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)


def reconciled(found: list[Found]) -> list[Found]:
    """Of the spans of all windows, those of the greatest total score that do not overlap; equal spans add up."""
    merged: dict[tuple, list[float]] = {}
    for f in found:
        merged.setdefault((f.end, f.start, f.kind), []).append(f.score)
    spans = sorted(merged)
    ends = [s[0] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for n, (_, start, _) in enumerate(spans):
        before = int(np.searchsorted(ends, start, side="right"))
        take = best[min(before, n)][0] + sum(merged[spans[n]])
        best.append((take, min(before, n), True) if take > best[-1][0] else (best[-1][0], n, False))
    out, n = [], len(spans)
    while n:
        _, to, taken = best[n]
        if taken:
            end, start, kind = spans[n - 1]
            out.append(Found(kind, start, end, max(merged[spans[n - 1]])))
        n = to
    return out[::-1]


def _centred(cut: list[tuple[int, int, int]], found: list[list[Found]], width: int) -> list[tuple[int, int]]:
    """Windows around the cut spans that no whole span holds, one for pieces that meet."""
    whole = {n: sorted((f.start, f.end) for f in found[n]) for n, _, _ in cut}
    reach = {n: np.maximum.accumulate([e for _, e in spans]) if spans else [] for n, spans in whole.items()}
    joined: list[list[int]] = []
    for n, start, end in sorted(cut):
        before = bisect_right(whole[n], (start, 1 << 60))
        if before and reach[n][before - 1] >= end:
            continue
        if joined and joined[-1][0] == n and start <= joined[-1][2] and max(end, joined[-1][2]) - joined[-1][1] < width // 2:
            joined[-1][2] = max(joined[-1][2], end)
        else:
            joined.append([n, start, end])
    return sorted({(n, max(0, (start + end - width) // 2)) for n, start, end in joined})


def added_spans(tagger: Tagger | None, texts: list[str], base: list[list[Span]], sure: float = SURE) -> list[list[Span]]:
    """The tagger's spans of each text that the base does not have."""
    if tagger is None:
        return [[] for _ in texts]
    places = [(n, at) for n, text in enumerate(texts) for at in windows(text)]
    found: list[list[Found]] = [[] for _ in texts]
    width = WIDTH
    while places:
        cut: list[tuple[int, int, int]] = []
        lots = max(1, AT_ONCE // width)
        for lot in range(0, len(places), lots):
            part = places[lot : lot + lots]
            for (n, at), spans in zip(part, window_spans(tagger, [texts[n][at : at + width] for n, at in part], width), strict=True):
                length = len(texts[n])
                for f in spans:
                    if (f.start > 0 or at == 0) and (f.end < width or at + width >= length):
                        found[n].append(Found(f.kind, at + f.start, at + f.end, f.score))
                    else:
                        cut.append((n, at + f.start, at + f.end))
        width *= 2  # until nothing is cut: a window as wide as its text cuts nothing
        places = _centred(cut, found, width)
    out = []
    for text, own, spans in zip(texts, base, found, strict=True):
        taken = sorted((s, e) for _, s, e in own)
        starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        keep = []
        for f in reconciled(spans):
            near = bisect_left(starts, f.end)  # base spans that begin before this one ends
            if f.score >= sure and not (near and reach[near - 1] > f.start) and plausible(f.kind, text[f.start : f.end]):
                keep.append((f.kind, f.start, f.end))
        out.append(keep)
    return out


def labelled_windows(docs: DataFrame) -> DataFrame:
    """(kind, text, tags) of every window around a digit, "@" or spelt-out "at"; ``kind`` is that of its first span."""

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            kinds, parts, tags = [], [], []
            for text in rows["text"].to_pylist():
                spans = base_spans(text)
                for at in windows(text):
                    row = tag_row(len(text), [s for s in spans if s[1] < at + WIDTH and s[2] > at], at)
                    first = next((t for t in row if t), 0)
                    kinds.append((first - 1) // 2 if first else -1)
                    parts.append(text[at : at + WIDTH])
                    tags.append(row)
            yield pa.table({"kind": pa.array(kinds, "int32"), "text": pa.array(parts, "string"), "tags": pa.array(tags, pa.list_(pa.int32()))})

    return map_arrow(docs.select("text").filter(F.col("text").rlike(_SPELT.pattern)), run, "kind int, text string, tags array<int>")


def learn(docs: DataFrame, per_kind: int = PER_KIND, steps: int = STEPS) -> Tagger | None:
    """A tagger trained on at most ``per_kind`` labelled windows of each kind and of none; None without any span."""
    chosen = sample_per_key(materialize(labelled_windows(docs), "pii-windows"), "kind", ["text"], per_kind).collect()
    rows = sorted({(r["text"], tuple(r["tags"])) for r in chosen})
    if not any(any(tags) for _, tags in rows):
        return None
    rng = np.random.default_rng(29)
    rows += [respelt(text, tags, rng) for text, tags in rows if any(tags)]
    tagger = Tagger()
    tagger.fit(char_ids([t for t, _ in rows]), np.array([list(tags) for _, tags in rows]), steps)
    return tagger


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame, per_kind: int = PER_KIND, steps: int = STEPS, sure: float = SURE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    The counts and ``base_sha256`` (of kind:start:end by kind and start, comma-joined) are of the base spans; ``spans`` has those and
    the tagger's, written the same way. Offsets count code points, ends are exclusive. A null text counts as empty.
    Repeated rows give equal results, an empty table no rows; other columns are ignored. If the sample holds no base span
    there is no tagger, and nothing is added.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    tagger = learn(docs, per_kind, steps)

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            texts = [t or "" for t in rows["text"].to_pylist()]
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            more = added_spans(tagger, texts, base, sure)
            out = {"doc_id": rows["doc_id"]}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = pa.array([sum(s[0] == k for s in spans) for spans in base], "int64")
            out["base_sha256"] = [hashlib.sha256(_written(spans).encode()).hexdigest() for spans in base]
            out["spans"] = [_written(a + b) for a, b in zip(base, more, strict=True)]
            yield pa.table(out)

    return map_arrow(docs, run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    joined: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if joined and s < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
        else:
            joined.append([k, s, e])
    for k, s, e in joined:
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, per_kind: int = PER_KIND, steps: int = STEPS, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` with personal data masked in ``text`` and ``n_chars`` counted anew; other texts, nulls included, unchanged."""
    tagger = learn(docs.select("text"), per_kind, steps)

    def run(slices: Iterator[pa.Table]) -> Iterator[pa.Table]:
        for rows in slices:
            texts = rows["text"].to_pylist()
            filled = [t or "" for t in texts]
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in filled]
            more = added_spans(tagger, filled, base, sure)
            new = [t if t is None else masked(t, a + b) for t, a, b in zip(texts, base, more, strict=True)]
            counts = [n if t is None or t == o else len(t) for n, t, o in zip(rows["n_chars"].to_pylist(), new, texts, strict=True)]
            rows = rows.set_column(rows.column_names.index("text"), "text", pa.array(new, "string"))
            yield rows.set_column(rows.column_names.index("n_chars"), "n_chars", pa.array(counts, "int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, schema)
