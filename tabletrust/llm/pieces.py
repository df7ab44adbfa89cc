"""SentencePiece (BPE model) encoding and decoding with a table of last tokens per prefix.

For every prefix of a text the encoding of that prefix ends in exactly one token, and a token sequence is the
encoding exactly when each neighbouring pair is: encoding the two tokens' joined text gives the pair back. So one
pass over the text finds, for each prefix end, the tokens that end there (an automaton over all pieces), takes the
one that is compatible with the last token of the prefix before it, and stores it. The ids are then read backwards.

No piece holds a white-space mark after another character, nor a line feed, so texts are cut there first and the
cuts are encoded on their own. Frequent cuts come from a memory of bounded size; the tables of all new cuts of a batch
are filled side by side, prefix end by prefix end.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from tabletrust.llm.common import unused

#: White-space mark of the library's models.
MARK = "▁"
NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6
#: Entries of the younger of two generations of a memory; the older one holds as many.
CUT_MEMORY, PAIR_MEMORY = 150_000, 200_000
#: Characters up to which a cut is remembered and filled side by side with others.
SHORT = 48
#: Characters from which a text is read in segments, and characters of texts that are encoded together.
SEGMENT = 1 << 20

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


#: Stands before the name of a cut without a mark.
BARE = "\x01"


class Memory:
    """What was used lately, in two generations of bounded size; the older one goes when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def among(self, keys) -> dict:
        """Every key with its value, None where it isn't remembered; keys of the older generation become young again."""
        young, old = self.young, self.old
        found = {k: young.get(k) for k in keys}
        again = {k: v for k, x in found.items() if x is None and (v := old.get(k)) is not None}
        if again:
            found |= again
            self.add(again)
        return found

    def add(self, entries: dict) -> None:
        """Remembers the entries; a generation may exceed its size by one call's entries."""
        self.young.update(entries)
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young


def segments(text: str) -> Iterator[str]:
    """Parts of about SEGMENT characters between which a space is left out that stands after another character: each
    part is encoded as a text of its own, whose first mark is that space."""
    at = 0
    while len(text) - at > SEGMENT:
        stop = text.find(" ", at + SEGMENT)
        while stop > 0 and text[stop - 1] == " ":
            stop = text.find(" ", stop + 1)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


class PieceModel:
    """Encoder and decoder for one BPE model file with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and an identity normaliser are read")
        self.text, self.score, self.size = {}, {}, {}
        self.bytes, self.byte_id = [b""] * len(proto.pieces), {}
        for i, p in enumerate(proto.pieces):
            if p.type in (NORMAL, USER_DEFINED, UNUSED):
                self.text[p.piece], self.score[i], self.size[i] = i, p.score, len(p.piece)
                self.bytes[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif p.type == 2:
                self.bytes[i] = b" \xe2\x81\x87 "
        marks = [s for s in self.text if not s.strip(MARK)]
        self.mark_ids = {len(s): self.text[s] for s in marks}
        lowest = min(self.score[i] for s, i in self.text.items() if s.strip(MARK))
        if any(re.search(f"[^{MARK}]{MARK}|\n", s) for s in self.text) or any(self.score[self.text[s]] >= lowest for s in marks if len(s) > 1) or len({self.score[self.text[s]] for s in marks if len(s) > 1}) > 1:
            raise ValueError("pieces cross the cuts this encoder makes")
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.automaton = ahocorasick.Automaton()
        self.left, self.right = {}, {}
        for s, i in self.text.items():
            if s.strip(MARK) or len(s) == 1:
                self.automaton.add_word(s, (i, len(s)))
                self._spines(s, i)
        self.automaton.make_automaton()
        self.pairs, self.known = Memory(PAIR_MEMORY), Memory(CUT_MEMORY)
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], np.int32)
        self.size_of = np.ones(len(proto.pieces) + 1, np.int32)  # the last entry: a character that is no piece
        self.size_of[list(self.size)] = list(self.size.values())
        self.id_text = [str(i) for i in range(len(proto.pieces))]
        self._trie()

    def _merge(self, symbols: list[str]) -> tuple[list[str], list[tuple[str, str, str]]]:
        """The plain definition: join the best-scored pair, leftmost of equals, until none is a piece."""
        made = []
        while True:
            best = None
            for k in range(len(symbols) - 1):
                i = self.text.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = self.score[i], k
            if best is None:
                return symbols, made
            k = best[1]
            made.append((symbols[k], symbols[k + 1], symbols[k] + symbols[k + 1]))
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]

    def _spines(self, s: str, i: int) -> None:
        """For a piece the nodes on its outer edges, from one character up: (text, score of being merged)."""
        left, right = [(s[0], 0.0)], [(s[-1], 0.0)]
        if len(s) > 1:
            end, made = self._merge(list(s))
            if end != [s]:
                self.left[i] = self.right[i] = None  # never made by merging
                return
            at_left, at_right = s[0], s[-1]
            # Only merges that touch an edge of the piece extend its spine; an inner node of equal text doesn't.
            spans = [(k, k + 1) for k in range(len(s))]
            for a, b, whole in made:
                for k in range(len(spans) - 1):
                    if s[spans[k][0] : spans[k][1]] == a and s[spans[k + 1][0] : spans[k + 1][1]] == b:
                        spans[k : k + 2] = [(spans[k][0], spans[k + 1][1])]
                        if spans[k][0] == 0:
                            at_left = whole
                            left.append((whole, self.score[self.text[whole]]))
                        if spans[k][1] == len(s):
                            at_right = whole
                            right.append((whole, self.score[self.text[whole]]))
                        break
            assert at_left == at_right == s
        self.left[i], self.right[i] = left, right

    def _fits(self, a: int, b: int) -> bool:
        """Whether the joined text of two pieces is encoded as just these two."""
        x, y = self.right[a], self.left[b]
        if x is None or y is None:
            return False
        i = j = 0
        while True:
            grow_x = x[i + 1][1] if i + 1 < len(x) else None
            grow_y = y[j + 1][1] if j + 1 < len(y) else None
            across = self.text.get(x[i][0] + y[j][0])
            if across is not None:
                s = self.score[across]
                if (grow_x is None or s > grow_x) and (grow_y is None or s >= grow_y):
                    return False
            if grow_x is None and grow_y is None:
                return True
            if grow_y is None or (grow_x is not None and grow_x >= grow_y):
                i += 1
            else:
                j += 1

    def marks(self, n: int) -> list[int]:
        """Ids of a run of n white-space marks. They score below all other pieces, so they merge last, and all alike, so
        the leftmost pair that is a piece is always the next to join: left of it there is none, so one pass will do."""
        sizes: list[int] = []
        for _ in range(n):
            top = 1
            while sizes and sizes[-1] + top in self.mark_ids:
                top += sizes.pop()
            sizes.append(top)
        return [self.mark_ids[k] for k in sizes]

    def _trie(self) -> None:
        """The pieces that merging can make, as a trie in sorted arrays of edges."""
        kinds = sorted({c for s in self.text for c in s})
        self.kinds = np.zeros(0x110000, np.int64)
        self.kinds[[ord(c) for c in kinds]] = np.arange(1, len(kinds) + 1)
        self.width = len(kinds) + 1
        nodes: dict[int, int] = {}
        tokens = {}
        for s, i in self.text.items():
            if self.left.get(i) is None:
                continue
            node = 0
            for c in s:
                node = nodes.setdefault(node * self.width + int(self.kinds[ord(c)]), len(nodes) + 1)
            tokens[node] = i
        self.edges = np.array(sorted(nodes), np.int64)
        self.children = np.array([nodes[e] for e in self.edges.tolist()], np.int64)
        self.token_at = np.full(len(nodes) + 1, -1, np.int64)
        self.token_at[list(tokens)] = list(tokens.values())

    def _ending(self, kinds: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, token and length of every piece in a row of characters. room: characters left in a character's own cut."""
        at, node, found = np.arange(len(kinds)), np.zeros(len(kinds), np.int64), []
        for n in range(1, int(room.max(initial=0)) + 1):
            inside = room[at] >= n
            at, node = at[inside], node[inside]
            key = node * self.width + kinds[at + (n - 1)]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[edge] == key
            at, node = at[hit], self.children[edge[hit]]
            if not len(at):
                break
            token = self.token_at[node]
            whole = token >= 0
            found.append((at[whole] + (n - 1), token[whole], np.full(int(whole.sum()), n)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3

    def _tables(self, cuts: list[str]) -> list[bytes]:
        """The ids (32-bit, as bytes) of cuts, from their tables of last tokens, all filled from prefix to prefix at once."""
        if not cuts:
            return []
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        stops = np.cumsum(sizes)
        starts = stops - sizes
        cut_of = np.repeat(np.arange(len(cuts)), sizes)
        codes = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.arange(len(codes)) - starts[cut_of]
        ends, tokens, lengths = self._ending(self.kinds[codes], stops[cut_of] - np.arange(len(codes)))
        order = np.lexsort((-lengths, ends, place[ends]))
        ends, tokens, before = ends[order], tokens[order], (ends - lengths)[order]
        bounds = np.searchsorted(place[ends], np.arange(int(sizes.max()) + 1))
        last = np.full(len(codes), -1, np.int64)
        for low, high in zip(bounds, [*bounds[1:], len(ends)], strict=True):
            e, token, b = ends[low:high], tokens[low:high], before[low:high]
            left = np.where(b >= starts[cut_of[e]], last[b], -1)
            good = left < 0  # the cut's begin, or a character that is no piece, goes with every token
            keys, at = np.unique(left[~good] << 20 | token[~good], return_inverse=True)
            good[~good] = self._fitting(keys.tolist())[at]
            last[e[good][::-1]] = token[good][::-1]
        # The ids, backwards: from a cut's end, each token's length leads to the end of the one before it.
        ending, at = np.zeros(len(codes), bool), stops - 1
        while len(at):
            ending[at] = True
            step = at - self.size_of[last[at]]
            at = step[step >= starts[cut_of[at]]]
        at = np.flatnonzero(ending)
        ids, of = last[at], cut_of[at]
        if (ids < 0).any():
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[at[ids < 0]].tolist()]
            times = np.ones(len(at), np.int64)
            times[ids < 0] = list(map(len, spelled))
            ids, of = np.repeat(ids, times), np.repeat(of, times)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        data, upto = ids.astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(of, minlength=len(cuts)))).tolist()
        return [data[low:high] for low, high in zip([0, *upto], upto, strict=False)]

    def _fitting(self, keys: list[int]) -> np.ndarray:
        found = self.pairs.among(keys)
        new = {k: self._fits(k >> 20, k & 0xFFFFF) for k, good in found.items() if good is None}
        self.pairs.add(new)
        return np.array(list((found | new).values()), bool)

    def _table(self, s: str) -> list[int]:
        """Ids of one long cut by its table of last tokens; a character that is no piece ends every token."""
        size, done = len(s), -1
        last = [-1] * size
        for end, (token, n) in self.automaton.iter(s):
            if end != done and self.left[token] is not None and (end < n or (b := last[end - n]) < 0 or self._fitting([b << 20 | token])[0]):
                last[end], done = token, end
        out, end = [], size - 1
        while end >= 0:
            if last[end] < 0:
                out += [self.byte_id[b] for b in reversed(s[end].encode("utf-8", "surrogatepass"))]
                end -= 1
            else:
                out.append(last[end])
                end -= self.size[last[end]]
        return out[::-1]

    def encode_cut(self, s: str) -> list[int]:
        """Ids of any cut: marks, then other characters; or a line feed."""
        if s == "\n":
            return [self.byte_id[10]]
        body = s.lstrip(MARK)
        n = len(s) - len(body)
        if not body:
            return self.marks(n)
        ids = self._table(MARK * min(n, 1) + body)
        if n > 1:
            joined = ids[0] != self.text[MARK]
            ids = [*self.marks(n - joined), *ids[not joined :]]
        return ids

    def cuts(self, text: str) -> list[str]:
        """The cuts of a text by name: a cut without its first mark; after BARE, one that has none; or, from two marks on, as it is."""
        plain = text.replace("\n", f" \n {BARE}")
        if "  " not in plain and plain[:1] != " " and plain[-1:] != " " and MARK not in text and BARE not in text:
            return plain.split(" ")
        named = []
        for c in self.cut(MARK + text.replace(" ", MARK)):
            rest = c[1:] if c[0] == MARK else BARE + c
            named.append("\n" if c == "\n" else c if rest[:1] in ("", MARK, "\n") or (c[0] == MARK and rest[0] == BARE) else rest)
        return named

    def learn(self, names: set[str]) -> dict[str, bytes]:
        """The ids of cuts by name: of those not remembered, short ones together and the others one by one."""
        found = self.known.among(names)
        short, cuts = [], []
        for name in [k for k, v in found.items() if v is None]:
            if name[:1] in (MARK, "\n") or len(name) > SHORT:
                cut = name[1:] if name[:1] == BARE else name if name[:1] in (MARK, "\n") else MARK + name
                found[name] = np.array(self.encode_cut(cut), np.int32).tobytes()
            elif name == BARE:
                found[name] = b""
            else:
                short.append(name)
                cuts.append(name[1:] if name[0] == BARE else MARK + name)
        made = dict(zip(short, self._tables(cuts), strict=True))
        self.known.add(made)
        return found | made

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, in order. About SEGMENT characters are encoded together, longer texts in segments."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and (at == first or size + len(texts[at] or "") <= SEGMENT):
                size += len(texts[at] or "")
                at += 1
            parts = [list(segments(t)) if t else [] for t in texts[first:at]]
            if size <= SEGMENT:
                named = [self.cuts(p[0]) if p else [] for p in parts]
                ids = self.learn(set(chain.from_iterable(named)))
                for names in named:
                    yield np.frombuffer(b"".join([ids[n] for n in names]), np.int32)
            else:
                yield np.frombuffer(b"".join(self._segment(s) for s in parts[0]), np.int32)

    def _segment(self, text: str) -> bytes:
        names = self.cuts(text)
        ids = self.learn(set(names))
        return b"".join([ids[n] for n in names])

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids) -> str:
        pieces = self.bytes
        text = b"".join([pieces[i] for i in ids or ()]).decode("utf-8", "each_byte")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the array of ids of each whole text.

    Null and empty texts have no ids (an empty array); texts of any length, runs of white space and characters that are no
    piece are encoded whole. Repeated rows and rows with equal or null keys are encoded each; an empty table gives no
    rows. All columns of df stay; one named `out` is replaced. model_path must name the model file on every executor.
    """
    return _mapped(df, text, {out: ("array<int>", pa.list_(pa.int32()))}, lambda m, values: [list(m.encode_all(values))], model_path)


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids (null and empty: empty text); byte pieces that aren't UTF-8 become U+FFFD each.

    Every row is decoded on its own; an empty table gives no rows; all columns of df stay, one named `out` is replaced.
    """
    return _mapped(df, ids, {out: ("string", pa.string())}, lambda m, values: [[m.decode(v) for v in values]], model_path)


def round_trip(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: each whole text is encoded, and its ids decoded again, in one pass
    that ships neither. Null and empty texts have no ids and decode to the empty text. Columns of these names are replaced."""

    def work(m: PieceModel, values: list) -> list[list]:
        n, ids_hash, decoded_hash = [], [], []
        for ids in m.encode_all(values):
            n.append(len(ids))
            ids = ids.tolist()
            ids_hash.append(hashlib.sha256(",".join([m.id_text[i] for i in ids]).encode()).hexdigest())
            decoded_hash.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
        return [n, ids_hash, decoded_hash]

    added = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _mapped(df, text, added, work, model_path)


def _mapped(df: DataFrame, column: str, added: dict[str, tuple[str, pa.DataType]], work: Callable, model_path: str) -> DataFrame:
    """df with the columns that `work` makes of each part of a batch. The source column may itself be replaced."""
    others = [c for c in df.columns if c not in added]
    shape = df.select(*others, *(F.lit(None).cast(kind).alias(c) for c, (kind, _) in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                made = work(m, part.column(part.num_columns - 1).to_pylist())
                arrays = [pa.array(v, kind) for v, (_, kind) in zip(made, added.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=shape.names)

    return df.select(*others, F.col(column).alias(unused(df, "_source"))).mapInArrow(run, shape)
