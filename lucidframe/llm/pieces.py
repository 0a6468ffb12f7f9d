"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder is a score-ordered agenda of adjacent symbol pairs: a text starts as its characters, the adjacent pair whose
union has the best score (the leftmost of equals) is joined, its neighbours' pairs are entered anew, until no pair
is in the vocabulary; what is left and unknown becomes UTF-8 byte pieces.

Merges never cross a place whose two characters stand side by side in no piece. Characters that are linked by standing
side by side make up a kind (letters, marks, a digit alone), so a text is cut where spaces begin and where the kind
changes, and equal segments are encoded once. Short segments run through the agenda together as columns of numpy
matrices, long ones through a heap.

In each Arrow batch the ids of all its new segments are checked against the sentencepiece library, and each text is
decoded twice, by this module and by the library from the same ids; a difference raises an error. A worker's memory of
segments is bounded by `KNOWN` in number and `HELD` in characters and ends with its task. Texts longer than `TOGETHER` are
encoded, decoded and digested in parts cut between segments.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; an empty table gives an
empty result; white space, control characters and literal special strings are ordinary text. Whole texts are encoded,
however long. `encode` reads only the id and text columns, whatever others there are, and returns the id under its name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidframe.llm.common import empty_text, has_columns, small_batches
from lucidframe.shipping import ship

SPACE = "▁"
#: Segments, and their characters, that a worker remembers; beyond the first it keeps the half that it used most.
KNOWN, HELD = 200_000, 4 << 20
#: Longest segment that runs in a matrix; fewer than 64, as its place takes six bits.
WIDE = 48
#: Characters of texts that are cut into segments together.
TOGETHER = 1 << 19
#: Segments of a matrix, and characters that the library checks at a time.
ROWS, STRETCH = 4096, 1 << 14


class Vocabulary:
    """Ranks, unions of adjacent symbols and cutting rules of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        size = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if lib.encode(f"{SPACE} a  ") != lib.encode("  a" + SPACE * 2):
            raise ValueError("only vocabularies without text normalisation are supported")
        normal = {p: i for i, p in enumerate(pieces) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        # What a piece stands for in a text; an ASCII byte is a character of its own, others make one up together.
        self.surface = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.high = {i for i, b in self.byte_of.items() if b >= 128}
        self.digits = [str(i) for i in range(size)]
        self.known_ids = size
        # Symbols: the pieces by id, then characters that only occur inside pieces.
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, size + len(symbol) - len(normal))
        self.single = np.full(max(map(ord, (c for c in symbol if len(c) == 1))) + 1, -1, np.int32)
        for c, s in symbol.items():
            if len(c) == 1:
                self.single[ord(c)] = s
        scores = {i: lib.get_score(i) for i in normal.values()}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values())))}  # equal scores, equal ranks
        found, pairs = [], set()
        for p, i in normal.items():
            pairs.update(zip(p, p[1:]))
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    found.append((a << 32 | b, i, rank[scores[i]] << 6))
        found.sort()
        self.keys, self.joined, self.ranks = (np.array(x, kind) for x, kind in zip(zip(*found), (np.int64, np.int32, np.int32)))
        self.scalar_keys = array("q", self.keys.tobytes())
        if any(b == SPACE and a != SPACE or "\n" in (a, b) for a, b in pairs):
            raise ValueError("the vocabulary joins words or lines; cutting there would change its ids")
        self.cut = _cutter(pairs)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the union of two symbols stands in the lists of unions, and whether there is one."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == key) & (left >= 0) & (right >= 0)

    def _symbols(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(code < len(self.single), self.single[np.minimum(code, len(self.single) - 1)], -1)

    def _matrix(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agenda of many short segments at once, one in a column, one merge for each a round: symbols, and how many each has."""
        lengths = np.array([len(w) for w in words])
        n, wide = len(words), int(lengths.max())
        place = np.arange(wide + 1)[:, None]
        inside = place < lengths
        sym = np.full((wide + 1, n), -1, np.int32)
        sym.T[inside.T] = self._symbols("".join(words))
        after = np.broadcast_to(place + 1, sym.shape).astype(np.int32)
        before = np.broadcast_to(place - 1, sym.shape).astype(np.int32)
        alive = inside.copy()
        # Rank and place of each pair in one number: the greatest is the best pair, and the leftmost of equals.
        at, there = self._look(sym[:-1].ravel(), sym[1:].ravel())
        best = np.where(there, self.ranks[at], -1).reshape(wide, n)
        best = np.where(best >= 0, best | 63 - place[:-1].astype(np.int32), np.int32(-1))
        columns = np.arange(n)
        while len(columns):
            top = best.max(axis=0)
            live = top >= 0
            if not live.all():
                columns, best, top = columns[live], best[:, live], top[live]
                if not len(columns):
                    break
            here = np.arange(len(columns))
            i = 63 - (top & 63)
            j = after[i, columns]
            k = after[j, columns]
            at, _ = self._look(sym[i, columns], sym[j, columns])
            joined = self.joined[at]
            sym[i, columns], alive[j, columns] = joined, False
            after[i, columns] = k
            inner = k <= wide
            before[k[inner], columns[inner]] = i[inner]
            best[np.minimum(j, wide - 1), here] = -1
            # The pair to the right, and the one to the left, of the joined symbol.
            right = np.where(k <= wide, sym[np.minimum(k, wide), columns], -1)
            at, there = self._look(joined, right)
            best[i, here] = np.where(there, self.ranks[at] | 63 - i, -1)
            h = np.maximum(before[i, columns], 0)
            at, there = self._look(sym[h, columns], joined)
            inner = i > 0
            best[h[inner], here[inner]] = np.where(there, self.ranks[at] | 63 - h, -1)[inner]
        return sym.T[alive.T], alive.sum(axis=0)

    def _heap(self, word: str) -> list[int]:
        """The agenda of one long segment as a heap over a linked list."""
        sym = self._symbols(word).tolist()
        n = len(sym)
        before, after, alive = array("q", range(-1, n - 1)), array("q", range(1, n + 1)), bytearray(b"\1" * n)
        agenda: list[tuple[int, int, int, int, int, int]] = []

        def enter(a: int, b: int) -> None:
            left, right = sym[a], sym[b]
            if left >= 0 and right >= 0:
                at = bisect_left(self.scalar_keys, left << 32 | right)
                if at < len(self.scalar_keys) and self.scalar_keys[at] == left << 32 | right:
                    heapq.heappush(agenda, (-int(self.ranks[at]), a, b, left, right, int(self.joined[at])))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, a, b, left, right, joined = heapq.heappop(agenda)
            if not (alive[a] and alive[b] and sym[a] == left and sym[b] == right and after[a] == b):
                continue
            sym[a], alive[b] = joined, 0
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                enter(a, after[a])
            if before[a] >= 0:
                enter(before[a], a)
        return [s for s, x in zip(sym, alive) if x]

    def _bytes(self, symbols: list[int], word: str) -> list[int]:
        """Ids from symbols: what is no piece becomes the bytes of its character."""
        out, at = [], 0
        for s in symbols:
            if 0 <= s < self.known_ids:
                out.append(s)
                at += len(self.surface[s])
            else:
                out += [self.byte_ids[b] for b in word[at].encode("utf-8", "replace")]
                at += 1
        return out

    def encode_segments(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The segments in an order of their own, their ids one after the other, and how many each has."""
        words = sorted(words, key=len)
        short = next((i for i, w in enumerate(words) if len(w) > WIDE), len(words))
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for k in range(0, short, ROWS):
            part = words[k : min(k + ROWS, short)]
            own, n = self._matrix(part)
            strange = (own < 0) | (own >= self.known_ids)
            if strange.any():
                ends = np.cumsum(n)
                fixed = np.split(own, ends[:-1])
                for r in np.unique(np.searchsorted(ends, np.flatnonzero(strange), side="right")):
                    fixed[r] = np.array(self._bytes(fixed[r].tolist(), part[r]), np.int32)
                own, n = np.concatenate(fixed), np.array([len(x) for x in fixed])
            ids.append(own)
            counts.append(n)
        for w in words[short:]:
            own = np.array(self._bytes(self._heap(w), w), np.int32)
            ids.append(own)
            counts.append(np.array([len(own)]))
        return words, np.concatenate(ids), np.concatenate(counts)

    def check(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Compare with the library. A line end before a segment keeps its start as it is."""
        line = self.library.encode("\n")[1:]
        start, held, lo, at = 0, 0, 0, np.concatenate(([0], np.cumsum(counts)))
        for i, w in enumerate(words):
            held += len(w) + 1
            if held < STRETCH and i + 1 < len(words):
                continue
            theirs = np.array(self.library.encode("\n" + "\n".join(words[start : i + 1]))[1:], np.int32)
            mine = np.insert(ids[lo : at[i + 1]], np.repeat(at[start : i + 1] - lo, len(line)), line * (i + 1 - start))
            if not np.array_equal(mine, theirs):
                for w, k in zip(words[start : i + 1], range(start, i + 1)):
                    if self.library.encode("\n" + w)[1 + len(line) :] != ids[at[k] : at[k + 1]].tolist():
                        raise ValueError(f"ids of {w[:80]!r} differ from the sentencepiece library's")
                raise ValueError("ids differ from the sentencepiece library's")
            start, held, lo = i + 1, 0, at[i + 1]

    def decode(self, ids: list[int]) -> str:
        """Pieces put together, byte pieces as UTF-8, spaces restored, the leading one dropped."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            out, raw = [], bytearray()
            for i in ids:
                if i in self.high:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.surface[i])
            text = "".join(out) + raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and ids[0] not in self.byte_of else text


def _cutter(pairs: set[tuple[str, str]]) -> re.Pattern:
    """A pattern of segments: spaces and the characters of one kind after them. Of two kinds none stand side by side in a piece."""
    kind: dict[str, str] = {}

    def find(c: str) -> str:
        while kind.setdefault(c, c) != c:
            kind[c] = kind[kind[c]]
            c = kind[c]
        return c

    for a, b in pairs:
        if a != SPACE:
            kind[find(a)] = find(b)
        else:
            find(b)
    kinds: dict[str, list[str]] = {}
    for c in kind:
        if c != SPACE:
            kinds.setdefault(find(c), []).append(c)
    runs = sorted(kinds.values(), key=len, reverse=True)
    return re.compile("|".join([f"{SPACE}*[{''.join(map(re.escape, sorted(r)))}]+" for r in runs] + [f"{SPACE}+", "."]), re.S)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of stretches, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


class Coder:
    """Encodes and decodes texts with a bounded memory of segments: a number for each, and its ids in one array."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.number, self.held = vocabulary, {}, 0
        self.ids, self.count, self.uses = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the half that was used most, or nothing of segments that are long."""
        names = list(self.number)
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: len(names) // 2]) if self.held <= HELD else np.empty(0, np.int64)
        own = [names[i] for i in kept]
        self.number, self.held = dict(zip(own, range(len(own)))), sum(map(len, own))
        self.ids = self.ids[_spread(self.start[kept], self.count[kept])]
        self.count, self.uses = self.count[kept], self.uses[kept] // 2

    def _learn(self, segments: set[str]) -> None:
        if len(self.number) > KNOWN or self.held > HELD:
            self._forget()
        new = [s for s in segments if s not in self.number]
        if new:
            words, ids, counts = self.vocabulary.encode_segments(new)
            self.vocabulary.check(words, ids, counts)
            self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
            self.held += sum(map(len, words))
            self.ids, self.count = np.concatenate((self.ids, ids)), np.concatenate((self.count, counts))
            self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))
        self.start = np.cumsum(self.count) - self.count

    def encode(self, cut: list[list[str]]) -> list[list[int]]:
        """The ids of lists of segments."""
        joined = [s for segments in cut for s in segments]
        self._learn(set(joined))
        which = np.fromiter(map(self.number.__getitem__, joined), np.int64, len(joined))
        self.uses += np.bincount(which, minlength=len(self.uses))
        ids = self.ids[_spread(self.start[which], self.count[which])]
        edges = np.concatenate(([0], np.cumsum(self.count[which])))[np.cumsum([0, *map(len, cut)])]
        return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]

    def decode(self, ids: list[int], first: bool) -> str:
        """The text of a part's ids, by this module and by the library. A line end before a later part keeps its start as it is."""
        lead = [] if first else self.vocabulary.library.encode("\n")[1:]
        theirs = self.vocabulary.library.decode(lead + ids)
        if theirs != self.vocabulary.decode(lead + ids):
            raise ValueError(f"the text {theirs[:80]!r} that the sentencepiece library decodes differs")
        return theirs if first else theirs[1:]

    def parts(self, texts: list[str]) -> Iterator[list[tuple[int, bool, list[str]]]]:
        """Groups of (row, whether it begins there, segments) of about TOGETHER characters: whole texts, or stretches of long ones."""
        group, held = [], 0
        for row, text in enumerate(texts):
            text = SPACE + text.replace(" ", SPACE) if text else ""
            at, step = 0, TOGETHER
            while at < len(text):
                found = self.vocabulary.cut.findall(text, at, at + step)
                if at + step < len(text):
                    if len(found) == 1:
                        step *= 2
                        continue
                    found.pop()  # it may go on
                group.append((row, at == 0, found))
                size = sum(map(len, found)) if at + step < len(text) else len(text) - at
                at, held, step = at + size, held + size, TOGETHER
                if held >= TOGETHER:
                    yield group
                    group, held = [], 0
        if group:
            yield group


def _coded(coder: Coder, texts: list[str], with_ids: bool) -> list[list]:
    """Columns: n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    n = [0] * len(texts)
    sums = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
    held: list[tuple[list, list]] = [([], []) for _ in texts]
    digit = coder.vocabulary.digits.__getitem__
    for group in coder.parts(texts):
        for (row, first, _), ids in zip(group, coder.encode([x[2] for x in group])):
            decoded = coder.decode(ids, first)
            n[row] += len(ids)
            sums[row][0].update((("" if first else ",") + ",".join(map(digit, ids))).encode())
            sums[row][1].update(decoded.encode())
            if with_ids:
                held[row][0].extend(ids)
                held[row][1].append(decoded)
    out = [n, [a.hexdigest() for a, _ in sums], [b.hexdigest() for _, b in sums]]
    return [*out, [x for x, _ in held], ["".join(x) for _, x in held]] if with_ids else out


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded of each row."""
    has_columns(df, id_col, text_col)
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    fields = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(model_file))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = _coded(coder, part.column(1).to_pylist(), with_ids)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, kind) for x, kind in zip(found, fields.values())]], ["__lf_id", *fields])

    rows = df.select(F.col(f"`{id_col}`").alias("__lf_id"), empty_text(F.col(f"`{text_col}`")).alias("__lf_text"))
    extra = ", ids array<int>, decoded string" if with_ids else ""
    found = rows.mapInArrow(run, f"__lf_id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
    return found.withColumnRenamed("__lf_id", id_col)
