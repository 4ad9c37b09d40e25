"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field adds spans of kind ``model``: it
tags each token as the begin of a secret, inside or outside, from the shape of
the token, neighbouring words and marks, and features of the whole text, and is
decoded by Viterbi. It is trained on a bounded sample, with the values that the
patterns find as its labels, and so carries their looks and surroundings over
to secrets without a known form. Base spans always stay; a model span that
overlaps one is not reported again.

Offsets count code points, with an exclusive end. Missing and empty texts have
no span. Repeated rows are scanned each. With no labelled secret in the sample
the field adds nothing. Only ``doc_id`` and ``text`` are read.

A chain is a whole line. Of a long one, parts of PART tokens are decoded at the
same time, once for each tag that the token before may have; joining these gives
the best tags of the whole line, however long it is. Only lines of the training
sample are cut, at PART tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from grainmill.session import Scratch

KINDS = ["assign", "access", "hex", "model"]
MAX_SAMPLE = 20_000
MAX_LINES = 4_000
PART = 256
# Bytes of texts whose tokens are in memory at the same time, some 200 times their size.
BLOCK = 1 << 18

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Words near which a secret is likelier.
HINTS = [k.encode() for k in (*KEYS, "passphrase", "pwd", "access", "bearer", "auth", "credential", "private", "key")]

BEGIN, INSIDE, OUTSIDE = range(3)
SHARE_STEPS = np.array([0.02, 0.1, 0.25, 0.5, 0.75])


def base_spans(text: str) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, start of the value) of all base spans by start, then kind as listed."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                found.append((m.start(), "assign", m.end(), m.start(2)))
    if "AKIA" in text:
        found += [(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


LOWER, UPPER, DIGIT = (_table(bytes(range(a, b + 1))) for a, b in ((97, 122), (65, 90), (48, 57)))
SYMBOL = _table(b"+/_.-")
WIDE = _table(bytes(range(128, 256)))
VOWEL = _table(b"aeiouyAEIOUY")
HEXES = _table(b"0123456789abcdef")
BLANK = _table(b" \t\n\r\x0b\x0c")
RUN = LOWER | UPPER | DIGIT | SYMBOL | WIDE
# One of four classes whose changes inside a token are counted.
CLASS = (LOWER + 2 * UPPER + 3 * DIGIT).astype(np.uint8)

#: Codes of each feature group.
GROUPS = {"length": 12, "shape": 12 * 32, "digits": 36, "changes": 42, "vowels": 36, "context": 16, "near": 16 * 12, "file": 36}


@dataclass
class Tokens:
    """The tokens of a block of texts, one after the other."""

    starts: np.ndarray
    ends: np.ndarray
    chains: np.ndarray  # first token of each chain, and the number of tokens
    codes: np.ndarray  # tokens x groups


def tokens_of(block: list[bytes]) -> tuple[Tokens, np.ndarray]:
    """Tokens with their features, and where each text begins in the block."""
    blob = b"\n".join(block) + b"\n"
    data = np.frombuffer(blob, np.uint8)
    lengths = np.fromiter(map(len, block), np.int64, len(block)) + 1
    places = np.concatenate([[0], np.cumsum(lengths)])
    run = RUN[data]
    single = ~run & ~BLANK[data]
    before = np.concatenate([[False], run[:-1]])
    after = np.concatenate([run[1:], [False]])
    starts = np.flatnonzero(single | (run & ~before))
    ends = np.flatnonzero(single | (run & ~after)) + 1
    n = len(starts)
    text = np.searchsorted(places, starts, "right") - 1

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return total[ends] - total[starts]

    size = ends - starts
    lower, upper, digit, symbol, wide = (count(t[data]) for t in (LOWER, UPPER, DIGIT, SYMBOL, WIDE))
    kinds = CLASS[data]
    changed = np.concatenate([[False], kinds[1:] != kinds[:-1]])
    changes = count(changed) - changed[starts]
    long = np.searchsorted([2, 3, 5, 7, 9, 12, 16, 20, 24, 32, 48], size, "right")
    shape = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (symbol > 0) + 16 * (wide > 0)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.searchsorted(SHARE_STEPS, part / np.maximum(whole, 1), "right")

    wider = np.searchsorted([6, 10, 16, 20, 32], size, "right")
    hint = np.zeros(n + 4, bool)
    small = blob.lower()
    for word in HINTS:
        at = small.find(word)
        found = []
        while at >= 0:
            found.append(at)
            at = small.find(word, at + 1)
        if found:
            hint[np.searchsorted(starts, found, "right") + 2] = True  # shifted by 3
    single_token = data[starts] if n else np.zeros(0, np.uint8)
    mark = np.isin(single_token, list(b"=:")) & (size == 1)
    quote = np.isin(single_token, list(b"\"'`")) & (size == 1)

    def back(flags: np.ndarray, steps: int) -> np.ndarray:
        return np.concatenate([np.zeros(steps, bool), flags[: max(0, n - steps)]])[:n]

    near = hint[2 : n + 2] | hint[1 : n + 1] | hint[0:n]  # the three tokens before
    marked = back(mark, 1) | (back(quote, 1) & back(mark, 2))
    quoted = back(quote, 1)
    followed = np.concatenate([quote[1:], [False]])[:n]
    context = near + 2 * marked + 4 * quoted + 8 * followed
    per_text = lambda flags: np.bincount(text, flags, len(block))
    words = np.maximum(per_text(np.ones(n)), 1)
    file = np.searchsorted([0.001, 0.005, 0.02, 0.05, 0.15], per_text(mark) / words, "right") * 6
    file += np.searchsorted([0.005, 0.02, 0.05, 0.1, 0.3], per_text(digit > 0) / words, "right")
    codes = np.stack(
        [
            long,
            long * 32 + shape,
            share(digit, size) * 6 + wider,
            np.minimum(changes, 6) * 6 + wider,
            share(count(VOWEL[data]), lower + upper) * 6 + share(count(HEXES[data]), size),
            context,
            context * 12 + long,
            file[text] if n else np.zeros(0, np.int64),
        ],
        axis=1,
    ).astype(np.int32)
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])[starts]
    new = np.ones(n, bool)
    new[1:] = breaks[1:] != breaks[:-1]
    first = np.flatnonzero(new)
    return Tokens(starts, ends, np.append(first, n), codes), places


def _parts(chains: np.ndarray) -> np.ndarray:
    """The chains cut into parts of PART tokens."""
    n = int(chains[-1])
    within = np.arange(n) - np.repeat(chains[:-1], np.diff(chains))
    return np.append(np.flatnonzero(within % PART == 0), n)


def _columns(chains: np.ndarray, chosen: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The first tokens of all (or the chosen) chains, the second ones, and so on; longest chain first."""
    sizes, firsts = np.diff(chains), chains[:-1]
    if chosen is not None:
        sizes, firsts = sizes[chosen], firsts[chosen]
    order = np.argsort(-sizes, kind="stable")
    firsts, sizes = firsts[order], sizes[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        yield firsts[: np.searchsorted(-sizes, -step, "left")] + step


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    weights: list[np.ndarray] = field(default_factory=lambda: [np.zeros((n, 3)) for n in GROUPS.values()])
    moves: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    trained: bool = False

    def scores(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros((len(codes), 3))
        for k, w in enumerate(self.weights):
            total += w[codes[:, k]]
        return total

    def barred(self) -> np.ndarray:
        """Transition scores; a secret cannot go on where none began."""
        moves = self.moves.copy()
        moves[OUTSIDE, INSIDE] = -1e9
        return moves

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best tags, by Viterbi, of all chains at once."""
        n = len(tokens.starts)
        tags = np.full(n, OUTSIDE, np.int8)
        if not n or not self.trained:
            return tags
        score, moves = self.scores(tokens.codes), self.barred()
        parts = _parts(tokens.chains)
        opening = np.isin(parts[:-1], tokens.chains[:-1])
        begin = np.zeros((1, 1, 3))
        begin[..., INSIDE] = -1e9
        # Parts that open a chain start in one way, others in one for each tag before them.
        entered = np.full(len(parts) - 1, -1, np.int8)
        found = {}
        for first, ways in ((True, begin), (False, moves[None])):
            chosen = np.flatnonzero(opening == first)
            found[first] = self._walk(parts, chosen, score, moves, ways)
        # The best way through the parts of each long chain.
        rows = {first: {int(k): i for i, k in enumerate(found[first][0])} for first in (True, False)}
        at = 0
        finals = np.zeros(len(parts) - 1, np.int8)
        while at < len(opening):
            stop = at + 1
            while stop < len(opening) and not opening[stop]:
                stop += 1
            value = found[True][1][rows[True][at], 0]
            ways = []
            for k in range(at + 1, stop):
                both = value[:, None] + found[False][1][rows[False][k]]
                ways.append(both.argmax(0))
                value = both.max(0)
            finals[stop - 1] = value.argmax()
            for k in range(stop - 1, at, -1):
                entered[k] = finals[k - 1] = ways[k - 1 - at][finals[k]]
            at = stop
        for first in (True, False):
            chosen, _, steps, back = found[first]
            if not len(chosen):
                continue
            way = np.zeros(n, np.int8)
            sizes = np.diff(parts)[chosen]
            place = np.repeat(parts[:-1][chosen], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            way[place] = np.repeat(np.maximum(entered[chosen], 0) if not first else np.zeros(len(chosen), np.int8), sizes)
            tags[parts[1:][chosen] - 1] = finals[chosen]
            for at in steps[:0:-1]:
                tags[at - 1] = back[at, way[at] if not first else 0, tags[at]]
        return tags

    def _walk(
        self, parts: np.ndarray, chosen: np.ndarray, score: np.ndarray, moves: np.ndarray, ways: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Best scores at the ends of the chosen parts for each way to enter, and how they came about."""
        entries = ways.shape[1]
        back = np.zeros((len(score) if len(chosen) else 0, entries, 3), np.int8)
        steps = list(_columns(parts, chosen))
        ends = np.zeros((len(chosen), entries, 3))
        best = np.zeros((len(chosen), entries, 3))
        order = np.argsort(-np.diff(parts)[chosen], kind="stable")
        last = parts[1:][chosen][order] - 1
        for k, at in enumerate(steps):
            if not k:
                best = ways + score[at][:, None, :]
            else:
                paths = best[: len(at), :, :, None] + moves
                back[at] = paths.argmax(2)
                best = paths.max(2) + score[at][:, None, :]
            done = last[: len(at)] == at
            ends[order[: len(at)][done]] = best[done]
        return chosen, ends, steps, back

    def gradient(self, tokens: Tokens, gold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of the log likelihood, by the forward-backward recursion."""
        n = len(gold)
        score, moves = self.scores(tokens.codes), self.barred()
        ahead, behind = np.zeros((n, 3)), np.zeros((n, 3))
        steps = list(_columns(tokens.chains))
        add = np.logaddexp.reduce
        for k, at in enumerate(steps):
            if not k:
                ahead[at] = score[at]
                ahead[at, INSIDE] = -1e9
            else:
                ahead[at] = add(ahead[at - 1][:, :, None] + moves, axis=1) + score[at]
        flow = np.zeros((3, 3))
        for at in steps[:0:-1]:
            onward = moves[None] + (score[at] + behind[at])[:, None, :]
            behind[at - 1] = add(onward, axis=2)
        total = ahead + behind
        log_total = add(total, axis=1)
        for at in steps[1:]:
            both = ahead[at - 1][:, :, None] + moves[None] + (score[at] + behind[at])[:, None, :]
            flow -= np.exp(both - log_total[at][:, None, None]).sum(0)
            np.add.at(flow, (gold[at - 1], gold[at]), 1)
        del score, ahead, behind
        total -= log_total[:, None]
        error = np.eye(3)[gold]
        error -= np.exp(total, out=total)
        grads = [
            np.stack([np.bincount(tokens.codes[:, k], error[:, t], len(w)) for t in range(3)], 1)
            for k, w in enumerate(self.weights)
        ]
        return grads, flow

    def train(self, tokens: Tokens, gold: np.ndarray, rounds: int = 80, rate: float = 0.3, decay: float = 1e-3) -> None:
        """Adagrad ascent on the penalised log likelihood."""
        sums = [np.full_like(w, 1e-8) for w in self.weights]
        move_sum = np.full((3, 3), 1e-8)
        for _ in range(rounds):
            grads, flow = self.gradient(tokens, gold)
            for w, g, s in zip(self.weights, grads, sums, strict=True):
                g -= decay * w
                s += g * g
                w += rate * g / np.sqrt(s)
            flow -= decay * self.moves
            move_sum += flow * flow
            self.moves += rate * flow / np.sqrt(move_sum)
        self.trained = True


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows of about BLOCK bytes together."""
    rows, block, size = [], [], 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        rows.append(k)
        block.append(data)
        size += len(data)
        if size >= BLOCK:
            yield rows, block
            rows, block, size = [], [], 0
    if rows:
        yield rows, block


def _place(data: bytes, at: int) -> int:
    return len(data[:at].decode("utf-8", "surrogatepass"))


def find_spans(texts: list[str | None], model: Field) -> list[tuple[list[tuple], list[tuple]]]:
    """Of each text, the base spans and all spans, as (kind, start, end)."""
    results: list = [None] * len(texts)
    for rows, block in _blocks(texts):
        added: dict[int, list[tuple[int, int]]] = {}
        tokens, places = tokens_of(block)
        tags = model.decode(tokens)
        begins = np.flatnonzero(tags == BEGIN)
        for k in begins:
            stop = k + 1
            while stop < len(tags) and tags[stop] == INSIDE:
                stop += 1
            a, b = int(tokens.starts[k]), int(tokens.ends[stop - 1])
            row = int(np.searchsorted(places, a, "right")) - 1
            added.setdefault(row, []).append((a - int(places[row]), b - int(places[row])))
        for k, row in enumerate(rows):
            base = [(kind, a, b) for a, kind, b, _ in base_spans(texts[row] or "")]
            spans = list(base)
            for a, b in added.get(k, []):
                value = block[k][a:b].rstrip(b".-")
                a, b = _place(block[k], a), _place(block[k], a + len(value))
                if a < b and not any(x < b and a < y for _, x, y in base):
                    spans.append(("model", a, b))
            results[row] = (base, sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))
    return results


def _gold(text: str, data: bytes, tokens: Tokens) -> np.ndarray:
    """Tags of one text's tokens by the values of its base spans."""
    gold = np.full(len(tokens.starts), OUTSIDE, np.int8)
    for _, _, end, value in sorted(base_spans(text), key=lambda s: s[2] - s[3]):
        a = len(text[:value].encode("utf-8", "surrogatepass"))
        b = a + len(text[value:end].encode("utf-8", "surrogatepass"))
        first, last = np.searchsorted(tokens.ends, a, "right"), np.searchsorted(tokens.starts, b, "left")
        gold[first:last] = INSIDE
        if first < last:
            gold[first] = BEGIN
    return gold


def _lowest(lines: DataFrame, most: int) -> DataFrame:
    """The lines with ``place``, a hash, without those that surely are not among the ``most`` lowest.

    About twice as many stay. Else each task would send as many to the driver.
    """
    rows = lines.withColumn("place", F.xxhash64("codes"))
    total = lines.count()
    if total <= 2 * most:
        return rows
    low = rows.where(F.col("place") < 2**64 * 2 * most // total - 2**63)
    return low if low.count() >= most else rows


def fit_secrets(docs: DataFrame, max_sample: int = MAX_SAMPLE, max_lines: int = MAX_LINES) -> Field:
    """Train on the documents whose hashed id is lowest, about ``max_sample``.

    From these, lines with a labelled secret and, of every text, two others that
    a hash chooses from all its lines are gathered, at most ``max_lines`` of either
    sort, by hash.
    """
    total = docs.count()
    part = 1_000_000
    limit = part if total <= max_sample else int(part * max_sample / total)
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").where(
        F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(part)) < limit
    )

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                data = text.encode("utf-8", "surrogatepass")
                tokens, _ = tokens_of([data])
                gold = _gold(text, data, tokens)
                plain = []
                cuts = _parts(tokens.chains)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if (gold[a:b] != OUTSIDE).any():
                        out.append((True, tokens.codes[a:b].tobytes(), gold[a:b].tobytes()))
                    else:
                        codes = tokens.codes[a:b].tobytes()
                        plain = sorted([*plain, (zlib.crc32(codes), codes, gold[a:b].tobytes())])[:2]
                out += [(False, codes, tags) for _, codes, tags in plain]
            yield pd.DataFrame(out, columns=["hit", "codes", "gold"])

    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.settle(sample.mapInPandas(examples, "hit boolean, codes binary, gold binary"))
        model = Field()
        rows = []
        for hit in (True, False):
            chosen = _lowest(lines.where(F.col("hit") == hit), max_lines).orderBy("place", "gold").limit(max_lines)
            rows += chosen.select("codes", "gold").collect()
            if not rows:
                return model
    parts = [np.frombuffer(r["codes"], np.int32).reshape(-1, len(GROUPS)) for r in rows]
    gold = np.concatenate([np.frombuffer(r["gold"], np.int8) for r in rows]).astype(np.int64)
    chains = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    codes = np.concatenate(parts)
    del rows, parts  # as large as the codes
    nothing = np.zeros(0, np.int64)
    model.train(Tokens(nothing, nothing, chains, codes), gold)
    return model


SPANS = "array<struct<kind:string,start:long,stop:long>>"


def scan_secrets(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, base and spans: arrays of kind, start and stop, by start, then kind as listed."""

    @pandas_udf(f"base {SPANS}, spans {SPANS}")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = find_spans(list(texts), model)
        named = [[[{"kind": k, "start": a, "stop": b} for k, a, b in part] for part in row] for row in rows]
        return pd.DataFrame({"base": [r[0] for r in named], "spans": [r[1] for r in named]})

    rows = docs.select("doc_id", found("text").alias("found"))
    return rows.select("doc_id", "found.base", "found.spans")


def joined(spans: str) -> Column:
    """kind:start:end of each span, with commas."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(parts, ",")


def number_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(texts: pd.Series, model: Field, mask: str = "[SECRET]") -> pd.Series:
    """The texts with each secret replaced by the mask; other texts stay as they are."""
    out = []
    for text, (_, spans) in zip(texts, find_spans(list(texts), model), strict=True):
        if spans:
            parts, at = [], 0
            for _, a, b in spans:
                if b > at:
                    if a >= at:
                        parts += [text[at:a], mask]
                    at = b
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pd.Series(out)
