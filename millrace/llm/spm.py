"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For every prefix of a piece of text the encoder stores the one token that ends
its encoding.  An Aho-Corasick automaton gives the vocabulary entries that end
at a position; an entry is the last token exactly if it can follow the stored
last token of the prefix before it, and two tokens can follow each other if
their joined text encodes to just these two.  The ids are read off backwards.

Text is cut where no merge can cross: before a space mark that follows another
character, and around characters the vocabulary lacks (these become bytes).
Runs of several space marks hold merges of equal score, for which pairs don't
decide; they are merged by score and place directly.

Null and empty texts give no ids and decode to the empty string.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

SPACE = "▁"
#: Pieces of text in each of the two generations whose ids a worker remembers (some 60 MB at most), and the longest one.
MEMO, MEMO_CHARS = 250_000, 64
#: Pairs of tokens whose compatibility it remembers.
PAIRS = 500_000


class Memo(dict):
    """The ids of pieces seen lately: what was used neither in this generation nor in the last is forgotten."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], most: int = MEMO):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class PrefixTableEncoder:
    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.id_of = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.piece = {i: p for p, i in self.id_of.items()}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unk = sp.unk_id()
        self.chars = {p for p in self.id_of if len(p) == 1}
        # With such a piece a merge could cross a space mark, and text may not be cut there.
        self.crosses = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) == 1 or self.merge(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.follows: dict[int, bool] = {}
        self.names = [str(i) for i in range(n)]
        self.unknown = re.compile(f"([^{re.escape(''.join(sorted(self.chars)))}])")
        self.inner = Memo(self.known)
        self.words = Memo(lambda word: self.segment(SPACE + word))

    def merge(self, text: str) -> list[int]:
        """Merge by score, then by place: the definition that the table must reproduce."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (joined := part[a] + part[b]) in self.score:
                heapq.heappush(heap, (-self.score[joined], a, b, joined))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] is None or part[b] is None or part[a] + part[b] != joined or right[a] != b:
                continue
            part[a], part[b] = joined, None
            right[a] = right[b]
            if right[a] < len(part):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.id_of[p] for p in part if p is not None]

    def can_follow(self, a: int, b: int) -> bool:
        if len(self.follows) > PAIRS:
            self.follows.clear()
        found = self.follows[a << 32 | b] = self.merge(self.piece[a] + self.piece[b]) == [a, b]
        return found

    def table_ids(self, text: str) -> tuple[int, ...]:
        """Ids of a text whose characters are all in the vocabulary."""
        tokens, begins = [-1] * (len(text) + 1), [-1] * (len(text) + 1)
        follows = self.follows
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if begins[end] >= 0:
                continue
            start = end - size
            if start:
                before = tokens[start]
                found = follows.get(before << 32 | token)
                if not (self.can_follow(before, token) if found is None else found):
                    continue
            tokens[end], begins[end] = token, start
        ids, at = [], len(text)
        while at:
            ids.append(tokens[at])
            at = begins[at]
        return tuple(reversed(ids))

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of any text: characters that the vocabulary lacks become bytes, what stands between them is encoded."""
        parts = self.unknown.split(text)
        ids = list(self.known(parts[0]))
        for other, piece in zip(parts[1::2], parts[2::2], strict=True):
            ids += [self.byte_id[b] for b in other.encode()] if self.byte_id else [self.unk]
            ids += self.inner[piece]
        return tuple(ids)

    def known(self, text: str) -> tuple[int, ...]:
        if not text:
            return ()
        return tuple(self.merge(text)) if SPACE * 2 in text else self.table_ids(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if self.crosses:
            return list(self.segment(text))
        parts = text.split(SPACE)
        if parts[0] == "" and "" not in parts[1:]:
            parts = parts[1:]
        else:  # runs of space marks stay with the word after them
            parts = [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", text)]
        words = self.words
        return list(chain.from_iterable([words[p] for p in parts]))

    def numbers(self, ids: list[int]) -> str:
        """The ids in decimal, with commas between."""
        return ",".join([self.names[i] for i in ids])


_encoders: dict[str, PrefixTableEncoder] = {}


def encoder(model_file: str) -> PrefixTableEncoder:
    """One encoder a worker process."""
    if model_file not in _encoders:
        _encoders[model_file] = PrefixTableEncoder(model_file)
    return _encoders[model_file]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Columns that encode_decode() can return.
FIELDS = {
    "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}
_ARROW = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode_decode(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``key`` and the asked columns of FIELDS for each row; rows are independent, nothing is shuffled.

    The ids are those of the sentencepiece library for the same model without
    begin or end ids; the decoded text is the library's for these ids.
    """
    ship(docs.sparkSession)
    source = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    schema = T.StructType([T.StructField(key, source.schema[0].dataType), *(T.StructField(o, FIELDS[o]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        decodes = any(o.startswith("decoded") for o in outputs)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                made: dict[str, list] = {o: [] for o in outputs}
                for t in b.column(1):
                    ids = enc.encode(t.as_py())
                    back = enc.sp.decode(ids) if decodes and ids else ""
                    for o, values in made.items():
                        values.append(
                            ids if o == "ids" else back if o == "decoded" else len(ids) if o == "n_tokens"
                            else _sha(enc.numbers(ids)) if o == "ids_sha256" else _sha(back)
                        )
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, _ARROW[o]) for o, v in made.items())], names=[key, *outputs])

    return source.mapInArrow(run, schema)
