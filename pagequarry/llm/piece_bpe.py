"""Encoding and decoding with a SentencePiece BPE model by a merge-type prefix table.

For every prefix of a piece of text the table stores the one token that the encoding of this
prefix ends with.  An Aho-Corasick automaton over the vocabulary lists the tokens that end at a
position; such a token is the last one exactly if it is compatible with the last token of the
prefix before it, where two tokens are compatible if merging their joined text gives just these
two again.  The ids are then read off backwards from the whole text's entry.

White space is handled as the model file says (a leading space is added, spaces become U+2581,
nothing else is normalised).  Since no vocabulary entry has U+2581 after another character, the
text is cut before every run of U+2581 without changing the encoding, and the encodings of such
segments are kept in a bounded cache; clearing the cache costs time, never results.  New segments
are encoded in sorted order, so that the table of a shared prefix is used again.

Characters without an entry become byte tokens.  Models with another normalisation, or of another
kind, are refused.

Defined cases: null counts as empty; the empty text has only the begin and end ids; a segment of
any length takes time and memory in proportion to its length; a null doc_id stays null; rows that
repeat a doc_id are encoded each; of merges of one rank the leftmost is done first; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SPACE_MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NEVER = float("inf")


class _Packed(dict):
    """Packed ids by token; a character without an entry has the ids of its bytes."""

    def __init__(self, model: PieceBpe):
        super().__init__({k: struct.pack("<I", i) for k, i in model.id_of.items()})
        self.bytes_id = model.bytes_id

    def __missing__(self, token: str) -> bytes:
        return b"".join(struct.pack("<I", self.bytes_id[x]) for x in token.encode())


#: Texts are encoded together in groups of about so many characters.
_GROUP_CHARS = 1 << 20


class PieceBpe:
    """A SentencePiece BPE model; see the module's text."""

    def __init__(self, model_file: str, cache_segments: int = 800_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and leading space marks are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("this model's normalisation is not supported")
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.bytes_id = [0] * 256
        self.bos, self.eos = 1, 2
        #: The bytes each id stands for when decoded.
        self.surface: list[bytes] = []
        for i, p in enumerate(proto.pieces):
            surface = b""
            if p.type == _NORMAL:
                self.rank[p.piece], self.id_of[p.piece] = -p.score, i
                surface = p.piece.replace(SPACE_MARK, " ").encode()
            elif p.type == _BYTE:
                self.bytes_id[int(p.piece[3:5], 16)] = i
                surface = bytes([int(p.piece[3:5], 16)])
            elif p.type == _UNKNOWN:
                surface = " ⁇ ".encode()
            elif p.type == _CONTROL:
                self.bos, self.eos = (i if p.piece == "<s>" else self.bos), (i if p.piece == "</s>" else self.eos)
            else:
                raise ValueError(f"pieces of type {p.type} are not supported")
            self.surface.append(surface)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.id_of):
            raise ValueError("a piece with a space mark after other characters is not supported")
        self._spines: dict[str, list[tuple[float, str, str]]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            if self._merges(piece)[1] == 1:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self._packed = _Packed(self)
        #: Packed ids by segment, without the space mark that each segment starts with.
        self.cache: dict[str, bytes] = {}
        self.cache_segments = cache_segments

    # -- pairs ---------------------------------------------------------------------------------

    def _merges(self, token: str) -> tuple[list[tuple[float, str, str]], int]:
        """The merges that form a token, each with its rank and the first and last part after it; and the parts left."""
        parts, rank = list(token), self.rank
        steps = [(-1.0, parts[0], parts[-1])]
        while len(parts) > 1:
            best, at = _NEVER, -1
            for k in range(len(parts) - 1):
                if (r := rank.get(parts[k] + parts[k + 1], _NEVER)) < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return steps, len(parts)

    def _steps(self, token: str) -> list[tuple[float, str, str]]:
        found = self._spines.get(token)
        if found is None:
            found = self._spines[token] = self._merges(token)[0]
        return found

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the text of both gives these two tokens: no merge across their border comes first."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is not None:
            return known
        a, b, i, j, rank = self._steps(left), self._steps(right), 0, 0, self.rank
        while True:
            across = rank.get(a[i][2] + b[j][1], _NEVER)
            next_a = a[i + 1][0] if i + 1 < len(a) else _NEVER
            next_b = b[j + 1][0] if j + 1 < len(b) else _NEVER
            # Of merges of one rank the leftmost is done first.
            if across < next_a and across <= next_b:
                good = False
                break
            if next_a == _NEVER and next_b == _NEVER:
                good = True
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= 600_000:
            self._pairs.clear()
        self._pairs[key] = good
        return good

    # -- encoding ------------------------------------------------------------------------------

    def _fill(self, segments: Iterable[str]) -> None:
        """Encode new segments into the cache."""
        self.cache.update(self._sorted(sorted(segments)))

    def _sorted(self, segments: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Segments and their packed ids; in sorted order they share the tables of their prefixes."""
        last: list[str] = []
        done = ""
        for key in segments:
            seg = SPACE_MARK + key
            common = 0
            for x, y in zip(seg, done):
                if x != y:
                    break
                common += 1
            del last[common:]
            self._extend(seg, last)
            done = seg
            yield key, self._recover(seg, last)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words, each as it is encoded after a space; words hold no space themselves.

        The cache serves and keeps what has room in it.
        """
        cache = self.cache
        found = [cache.get(w) for w in words]
        new = sorted((k for k, x in enumerate(found) if x is None), key=words.__getitem__)
        if len(cache) + len(new) > self.cache_segments:
            cache.clear()
        for k, (w, packed) in zip(new, self._sorted(words[k] for k in new)):
            found[k] = packed
            if len(cache) < self.cache_segments:
                cache[w] = packed
        return found

    def _extend(self, seg: str, last: list[str]) -> None:
        """Add the last tokens of the prefixes of ``seg`` that ``last`` has not got yet."""
        size, pairs, compatible = len(last), self._pairs, self.compatible
        for end, token in self.automaton.iter(seg):
            if end < size:
                continue
            while size < end:  # characters that end no token
                last.append(seg[size])
                size += 1
            start = end - len(token)
            if start >= 0:
                before = last[start]
                good = pairs.get((before, token))
                if good is None:
                    good = compatible(before, token)
                if not good:
                    continue
            last.append(token)
            size += 1
        while size < len(seg):
            last.append(seg[size])
            size += 1

    def _recover(self, seg: str, last: list[str]) -> bytes:
        packed, found, end = self._packed, [], len(seg)
        while end:
            token = last[end - 1]
            found.append(packed[token])
            end -= len(token)
        found.reverse()
        return b"".join(found)

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text with visible spaces, cut at each run of spaces; each segment lacks its first space mark."""
        if not text:
            return []
        if SPACE_MARK in text:
            text = text.replace(SPACE_MARK, " ")
        parts = text.split(" ")
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return parts
        found, run = [], -1
        for x in parts:
            run += 1
            if x:
                found.append(SPACE_MARK * run + x)
                run = -1
        return found + [SPACE_MARK * run] if run >= 0 else found

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text without begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.segments(x) for x in texts]
        cache = self.cache
        new = set().union(*cut).difference(cache)
        if len(cache) + len(new) > self.cache_segments:
            cache.clear()
            new = set().union(*cut)
        self._fill(new)
        get = cache.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def encode(self, text: str | None, ends: bool = True) -> list[int]:
        packed = self.encode_packed([text or ""])[0]
        ids = list(struct.unpack(f"<{len(packed) // 4}I", packed))
        return [self.bos, *ids, self.eos] if ends else ids

    # -- decoding ------------------------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; the space that encoding added goes, begin and end ids are silent."""
        text = b"".join(map(self.surface.__getitem__, ids))
        if text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about _GROUP_CHARS characters, of one row at least."""
    at = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if size and size + n > _GROUP_CHARS:
            yield batch.slice(at, k - at)
            at, size = k, 0
        size += n
    if batch.num_rows > at:
        yield batch.slice(at)


_loaded: dict[tuple, PieceBpe] = {}


def load(model_file: str, cache_segments: int = 800_000) -> PieceBpe:
    """The model, read once a worker process."""
    key = (model_file, cache_segments)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceBpe(model_file, cache_segments)
    return _loaded[key]


#: What encoding can return beside doc_id, n_tokens and the two digests.
OUTPUTS = {"ids": pa.binary(), "decoded": pa.string()}


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the outputs: a row for each row.

    ids: little-endian unsigned 32-bit integers, with begin and end; decoded: the text of the ids.
    """
    to = pa.schema({"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | {k: OUTPUTS[k] for k in outputs})
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {k} {OUTPUTS[k]}" for k in outputs)

    def run(batches):
        model = load(model_file)
        first, final = struct.pack("<I", model.bos), struct.pack("<I", model.eos)
        for batch in batches:
            for part in _groups(batch):
                rows = []
                texts = part.column(1).to_pylist()
                for doc_id, packed in zip(part.column(0).to_pylist(), model.encode_packed(texts)):
                    packed = first + packed + final
                    decoded = model.decode(memoryview(packed).cast("I"))
                    row = {"ids": packed, "decoded": decoded}
                    rows.append([doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *(row[k] for k in outputs)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to)], schema=to)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
