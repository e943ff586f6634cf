"""Ids of a word-level BPE tokenizer (lower case, word ends, white space dropped), by distinct words.

White space never takes part in a token, so texts are cut at it and each distinct word of a group of texts
is encoded once; the texts' ids are gathered from those of their words.  A word of Latin letters with punctuation
after it is merged byte by byte with the vocabulary's ranks; a byte stands for the end of a word.  That is
the same as merging the listed pairs, as the vocabulary has every pair's result at the pair's rank and each
entry's own text merges to just that entry.  All other words, and very long ones, go to the tokenizers
library, which also reads the special tokens.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_END = "</w>"
#: Stands for the end of a word; words with this character go to the library.
_END = "\x01"
#: Fixed value: where each piece of text ends, as the supported models have it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters whose lower case is one letter for one, none of which is composed anew, and punctuation that is one piece with itself.
_LETTER, _MARK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffĀ-į", r"!-/:-@\[-`{-~"
#: Longer runs go to the library.
_LONG = 256
_PLAIN = re.compile(rf"(?:([{_LETTER}]{{1,{_LONG}}})([{_MARK}]{{0,{_LONG}}})|([{_MARK}]{{1,{_LONG}}})|[^\n]*)\n")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class WordBpe:
    """A tokenizer of this kind; other kinds are refused."""

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        self.library = Tokenizer.from_file(tokenizer_file)
        of, special, end = byte_characters(), {t["content"] for t in spec["added_tokens"]}, _END.encode()
        ranks, ends = {}, []
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                core = token.removesuffix(WORD_END)
                ranks[bytes(of[c] for c in core) + (end if core != token else b"")] = i
                if core != token:
                    ends.append(i)
        self._ends = np.zeros(max(ranks.values()) + 1, bool)
        self._ends[ends] = True
        self._merge = tiktoken.Encoding("words", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _check(spec: dict) -> None:
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(model["vocab"].keys() - {t["content"] for t in spec["added_tokens"]}) - len(merges)
        if (
            (model["type"], model["end_of_word_suffix"], kinds) != ("BPE", WORD_END, ["NFC", "Replace", "Lowercase"])
            or pre[0]["pattern"] != {"Regex": PATTERN}
            or any(model["vocab"].get(a + b) != first + k for k, (a, b) in enumerate(merges))
            or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
        ):
            raise ValueError("only lower-casing BPE models with word ends, whose ids follow their merges, are supported")

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes): the ids of each word from its start on."""
        all_words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
        lines = pc.binary_join(all_words, b"\n")[0].as_py().decode("utf-8", "replace")
        pieces, of, others = [], [], []
        for k, (letters, marks, alone) in zip(range(len(words)), _PLAIN.findall(lines.lower() + "\n")):
            if letters:
                pieces.append(letters)
                of.append(k)
                if marks:
                    pieces.append(marks)
                    of.append(k)
            elif alone:
                pieces.append(alone)
                of.append(k)
            else:
                others.append(k)
        ids = np.array(self._merge(_END.join(pieces) + _END) if pieces else [], np.uint32)
        lengths = np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)
        sizes = np.bincount(of, weights=lengths, minlength=len(words)).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        parts, at = [ids], len(ids)
        if others:
            found = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in words.cast(pa.binary()).take(pa.array(others)).to_pylist()], add_special_tokens=False)
            for k, e in zip(others, found):
                parts.append(np.array(e.ids, np.uint32))
                starts[k], sizes[k] = at, len(e.ids)
                at += len(e.ids)
        return np.concatenate(parts), starts, sizes

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (an array of strings without nulls), as little-endian unsigned 32-bit integers."""
        split = pc.ascii_split_whitespace(texts)  # at six characters, which no token holds
        coded = split.flatten().dictionary_encode()
        ids, starts, sizes = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        n = sizes[word]
        ends = np.cumsum(n)
        at = np.repeat(starts[word] - (ends - n), n) + np.arange(int(n.sum()))
        gathered = ids[at].astype("<u4")
        offsets = split.offsets.to_numpy()
        cuts = np.concatenate([[0], ends])[offsets - offsets[0]]
        return [gathered[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


_loaded: dict[str, WordBpe] = {}


def word_bpe(tokenizer_file: str) -> WordBpe:
    """The tokenizer, loaded once in a process."""
    if tokenizer_file not in _loaded:
        _loaded[tokenizer_file] = WordBpe(tokenizer_file)
    return _loaded[tokenizer_file]


def as_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")
