"""SentencePiece (BPE) encoding and decoding by a merge-type prefix table.

A sequence of pieces is a text's encoding exactly when every piece is its own encoding and every two neighbours keep apart,
that is, no merge ever crosses the border between them. So each prefix of a text has one last piece: of the pieces that
an Aho-Corasick automaton finds to end there, the one that keeps apart from the last piece of what precedes it. The table
holds that piece for each prefix, and ids are recovered from its end backwards; any prefix's ids are in the same table.

Whether two pieces keep apart is found by replaying both pieces' own merges in the library's order (best score first,
leftmost among equals) and asking at each step whether a merge over the border would come first. Texts are normalised by
the library and cut where no piece can reach over (before a space mark behind another character); tables of distinct units
are remembered, up to ``UNITS`` of them for each worker. Characters without a piece become byte pieces.

Null texts are empty: no pieces but the end id, and they decode to the empty text. Very long texts are whole (the table is
linear in the text). Repeated rows each get a row, also with null ids; an empty table gives an empty result; other columns
are not looked at, and an id column may have any name but token_ids and decoded (ValueError). Models other than BPE, or
with user-defined or unused pieces, are refused (ValueError).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pieces_of
from tidemark.sources.shared import spread

MARK = "▁"  # stands for a space in pieces
#: Units, and pairs of pieces, that one worker remembers; beyond it they are worked out anew.
UNITS = 1_000_000
#: Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
NEVER = 1 << 60


class _Known(dict):
    """ids of units, made when asked for."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, unit: str) -> bytes:
        value = self.make(unit)
        if len(self) < self.most and len(unit) < 100:
            self[unit] = value
        return value


class PieceCoder:
    """encode, decode and prefix tables of one model file."""

    def __init__(self, path: str, units: int = UNITS):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is not a BPE model of plain pieces")
        self.dtype = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.texts = [p.piece for p in model.pieces]
        self.end_id = self.library.eos_id()
        own = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        by_score = sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True)
        order = {s: r for r, s in enumerate(by_score)}
        #: Place of each piece by score; equal scores share one, and then the leftmost merge comes first.
        self.rank = {t: order[model.pieces[i].score] for t, i in own.items()}
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.alphabet = {c for t in own for c in t}
        self.outside = re.compile(f"[^{re.escape(''.join(sorted(self.alphabet)))}]")
        # a character that only longer pieces have can be merged too: it stands for itself under a number behind the ids
        self.spare = [c for c in sorted(self.alphabet) if c not in own]
        self.texts += self.spare
        self.automaton = ahocorasick.Automaton()
        #: For each piece, whether it keeps apart from the piece before it, as far as that is known.
        self.apart: list[dict[int, bool]] = [{} for _ in self.texts]
        for t, i in [*own.items(), *((c, len(model.pieces) + k) for k, c in enumerate(self.spare))]:
            self.automaton.add_word(t, (i, len(t), self.apart[i].get))
        self.automaton.make_automaton()
        self.unknown = self.library.unk_id()
        self.surface = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        spec = model.normalizer_spec
        self.strips = spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        self.plain = self.strips and spec.escape_whitespaces  # decoding is the pieces' own texts, without the space added in front
        cut = not any(MARK in t.lstrip(MARK) for t in own)
        self.units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cut else "(?s).+")
        self.simple = cut
        self.histories: dict[int, tuple | None] = {}
        self.pairs = 0
        self.known = _Known(self._ids, units)
        self.behind_mark = _Known(lambda unit: self._ids(MARK + unit), units)

    def history(self, piece: int) -> tuple | None:
        """The merges that make a piece from its characters, as (rank, leftmost part, rightmost part) after each; None where
        its own text is encoded otherwise."""
        if piece not in self.histories:
            parts, steps, rank = list(self.texts[piece]), [], self.rank
            while len(parts) > 1:
                best, at = min((rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[0], parts[-1]))
            self.histories[piece] = tuple(steps) if len(parts) == 1 else None
        return self.histories[piece]

    def keeps_apart(self, a: int, b: int) -> bool:
        """Whether pieces a and b, side by side, are the encoding of their text (a = -1: b at the start)."""
        known = self.apart[b].get(a)
        if known is None:
            known = self._replay(a, b)
            if self.pairs < UNITS:
                self.apart[b][a] = known
                self.pairs += 1
        return known

    def _replay(self, a: int, b: int) -> bool:
        right = self.history(b)
        if right is None or a < 0:
            return right is not None
        left, rank = self.history(a), self.rank
        x, y, i, j = self.texts[a][-1], self.texts[b][0], 0, 0
        while True:
            across = rank.get(x + y, NEVER)
            mine, yours = left[i][0] if i < len(left) else NEVER, right[j][0] if j < len(right) else NEVER
            if across < mine and across <= yours:
                return False
            if mine == yours == NEVER:
                return True
            if mine <= yours:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def prefix_table(self, unit: str) -> list[int]:
        """The last piece of each prefix of a normalised text, from the empty one (-1). A character without a piece stands as
        -2 - its code point, and nothing reaches over it."""
        last: list = [None] * len(unit) + [-1]  # the empty prefix at the end, so that last[end of a match] is its prefix
        keeps = self.keeps_apart
        if self.outside.search(unit):
            for k, c in enumerate(unit):
                if c not in self.alphabet:
                    last[k] = -2 - ord(c)
        for end, (piece, size, known) in self.automaton.iter(unit):
            if last[end] is None:
                before = last[end - size]
                if before is not None:
                    fits = known(before)
                    if fits or fits is None and keeps(max(before, -1), piece):
                        last[end] = piece
        return last[-1:] + last[:-1]

    def recover(self, last: list[int], chars: int) -> list[int]:
        """ids of the prefix of so many characters, from its end backwards."""
        out: list[int] = []
        while chars:
            piece = last[chars]
            if 0 <= piece < len(self.surface):
                out.append(piece)
                chars -= len(self.texts[piece])
            else:
                char = chr(-2 - piece) if piece < 0 else self.texts[piece]
                out += [self.bytes_of[b] for b in reversed(char.encode())] if self.bytes_of else [self.unknown]
                chars -= 1
        return out[::-1]

    def _ids(self, unit: str) -> bytes:
        return array(self.code, self.recover(self.prefix_table(unit), len(unit))).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """ids of a whole text, without an end id."""
        text = self.library.normalize(text)
        if self.simple and MARK * 2 not in text:
            head, *tail = text.split(MARK)
            data = (self.known[head] if head else b"") + b"".join(map(self.behind_mark.__getitem__, tail))
        else:
            data = b"".join(map(self.known.__getitem__, self.units.findall(text)))
        return np.frombuffer(data, self.dtype)

    def decode(self, ids: list[int]) -> str:
        if not self.plain or self.unknown in ids:
            return self.library.decode(ids)
        data = b"".join(map(self.surface.__getitem__, ids))
        try:
            return data[data[:1] == b" " :].decode()
        except UnicodeDecodeError:  # bytes that are no text, which encode() never makes
            return self.library.decode(ids)


_made: dict[tuple[str, int], PieceCoder] = {}


def coder(path: str, units: int = UNITS) -> PieceCoder:
    """One for each worker process, file and number of units."""
    return _made.get((path, units)) or _made.setdefault((path, units), PieceCoder(path, units))


def encode_and_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, end: bool = True, decoded: bool = True) -> DataFrame:
    """id, token_ids (with the end id last, unless not wanted) and, if wanted, decoded: the text that they decode to."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    if id_col in ("token_ids", "decoded"):
        raise ValueError(f"the id column may not be called {id_col}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        last = np.array([own.end_id] * end, own.dtype)
        for batch in pieces_of(batches, 200):
            ids = [np.concatenate([own.encode(t or ""), last]) for t in batch["t"].to_pylist()]
            flat = np.concatenate(ids) if ids else last[:0]
            edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            out = {id_col: batch["i"], "token_ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat.astype(np.int32)))}
            if decoded:
                out["decoded"] = pa.array([own.decode(x.tolist()) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    rows = spread(df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")))
    return rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, token_ids array<int>" + ", decoded string" * decoded)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", model: str | None = None) -> DataFrame:
    """id and decoded: the text of a column of ids (null: null; null ids are left out; ids that the model has not raise)."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in pieces_of(batches, 200):
            texts = [None if x is None else own.decode([i for i in x if i is not None]) for x in batch["x"].to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch["i"], "decoded": pa.array(texts, pa.string())})

    rows = df.select(F.col(id_col).alias("i"), F.col(ids_col).cast("array<int>").alias("x"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, decoded string")


def op12_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    both = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest(F.concat_ws(" ", F.col("token_ids").cast("array<string>"))).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


ORACLE: dict[str, str] = {}
