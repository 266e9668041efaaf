"""Encode whole texts with the tokenizers library, each distinct word once.

A byte-level pre-tokenizer never lets a piece cross from a character that is not white
space to a following space, so a text's ids are the ids of its space-led words one after
the other. Words repeat, so each process keeps the ids of the words it has seen; the
library itself encodes every word that is new, many at a time as one text. A vocabulary
file with another pre-tokenizer, a normalizer, or added tokens that hold white space gets
whole texts instead.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MAX_WORDS = 900_000  # words a process keeps, some 250 bytes each; words past it are encoded whenever they come
STALE = 0.25  # share of a call's words that are not kept ones; from there on the process starts afresh
JOINED = 500  # new words that the library gets as one text
# White space by Unicode, for RE2, which knows the ASCII kind only.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"^$|^{_SPACE}|{_SPACE}{_SPACE}"
_SPACE_AFTER_TEXT = re.compile(r"(?<=\S) ")
_AS_IT_STANDS = "\n\n"  # before a piece that no space stands before; words never begin like that
# How the byte-level alphabet writes a space and a line break.
_LEADS = {" ": "\u0120", "\n": "\u010a"}


def splits_at_spaces(tokenizer_json: str) -> bool:
    """Whether a vocabulary file's texts may be encoded word by word."""
    made = json.loads(tokenizer_json)
    split = made.get("pre_tokenizer") or {}
    plain = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
             and made.get("normalizer") is None and made.get("model", {}).get("type") == "BPE" and not made["model"].get("ignore_merges"))
    return plain and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in made.get("added_tokens", ()))


class TextEncoder:
    """``encode`` returns the ids of many texts as one flat array and the number of ids of each."""

    def __init__(self, tokenizer_json: str, special_as_text: bool):
        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._tokenizer.encode_special_tokens = special_as_text
        self._by_words = splits_at_spaces(tokenizer_json)
        pieces = self._tokenizer.get_vocab(with_added_tokens=True)
        self._leads = {}
        for first, letter in _LEADS.items():
            self._leads[first] = np.zeros(max(pieces.values(), default=0) + 1, bool)
            self._leads[first][[i for piece, i in pieces.items() if piece.startswith(letter)]] = True
        self._reset()

    def _reset(self) -> None:
        self._known: dict[object, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._bounds = np.zeros(1 << 16, np.int64)

    def encode(self, texts: pa.Array | Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        if not self._by_words:
            return _flat([e.ids for e in self._tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode_words(*_plain_words(texts))
        plain = self._encode_words(*_plain_words(texts.filter(pa.array(~odd))))
        rest = self._encode_words(*_odd_words(texts.filter(pa.array(odd)).to_pylist()))
        # Back into one order.
        counts = np.empty(len(odd), np.int64)
        counts[~odd], counts[odd] = plain[1], rest[1]
        ids = np.empty(int(counts.sum()), np.uint32)
        of_odd = np.repeat(odd, counts)
        ids[~of_odd], ids[of_odd] = plain[0], rest[0]
        return ids, counts

    def _encode_words(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts from their words, one text after the other, and the words of each."""
        coded = words.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        known = self._known
        at = np.fromiter(map(known.get, distinct.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, len(distinct))
        new = at < 0
        before, used, learned = len(known), self._used, []
        if before >= MAX_WORDS and np.count_nonzero(new[codes]) > STALE * len(codes):
            self._reset()  # texts of another kind
            return self._encode_words(words, counts)
        if new.any():
            learned = self._learn(distinct.filter(pa.array(new)))
            at[new] = [known[w] for w in distinct.filter(pa.array(new)).to_numpy(zero_copy_only=False).tolist()]
        starts, lengths = self._bounds[at], self._bounds[at + 1] - self._bounds[at]
        starts, lengths = starts[codes], lengths[codes]
        total = np.cumsum(lengths)
        ids = self._ids[np.repeat(starts - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)]
        until = np.concatenate(([0], total))[np.concatenate(([0], np.cumsum(counts)))]
        if learned and before >= MAX_WORDS:
            for w in learned:
                del known[w]
            self._used = used
        return ids, np.diff(until)

    def _learn(self, words: pa.Array) -> list[str]:
        """Encode new words and keep their ids; returns the words in the order of their ids."""
        whole, broken = (pc.starts_with(words, x).to_numpy(zero_copy_only=False) for x in (_AS_IT_STANDS, "\n"))
        # A piece with white space in it, or nothing, is the library's alone; so are the marked ones.
        alone = whole | pc.match_substring_regex(words, rf"^\n?$|.{_SPACE}|^[^\n]*{_SPACE}").to_numpy(zero_copy_only=False)
        pieces = words.to_numpy(zero_copy_only=False)
        found: list[tuple[list[str], np.ndarray, np.ndarray]] = []  # words, their ids as one array, the number of ids of each
        rest = pieces[alone].tolist()
        for first, some in ((" ", ~alone & ~broken), ("\n", ~alone & broken)):
            own = pieces[some].tolist()
            parts = [own[k:k + JOINED] for k in range(0, len(own), JOINED)]
            texts = [" " + " ".join(part) if first == " " else "".join(part) for part in parts]
            for part, e in zip(parts, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                starts = np.flatnonzero(self._leads[first][ids])
                if len(starts) == len(part) and starts[0] == 0:
                    found.append((part, ids, np.diff(starts, append=len(ids))))
                else:  # a piece of another kind stands in one of the words
                    rest += part
        if rest:
            texts = [w[len(_AS_IT_STANDS):] if w.startswith(_AS_IT_STANDS) else w if w[:1] == "\n" else f" {w}" for w in rest]
            found.append((rest, *_flat([e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)])))
        order = list(chain.from_iterable(f[0] for f in found))
        first = len(self._known)
        self._known.update(zip(order, range(first, first + len(order)), strict=True))
        new = np.concatenate([f[1] for f in found])
        ends = self._used + np.cumsum(np.concatenate([f[2] for f in found]))
        self._ids = _grown(self._ids, self._used + len(new))
        self._ids[self._used:self._used + len(new)] = new
        self._bounds = _grown(self._bounds, first + len(order) + 1)
        self._bounds[first + 1:first + len(order) + 1] = ends
        self._used += len(new)
        return order


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size`` entries, at least doubled if it has to grow."""
    return values if size <= len(values) else np.concatenate([values, np.zeros(max(size, len(values)), values.dtype)])


def _plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces that encode alone as they do in the text, all texts one after the other, and their numbers.

    For texts that neither begin with white space nor have any of it run together. A piece is a
    word after a space, a word with its line break before it, or the text's first word, marked.
    """
    mark, nothing = (pa.scalar(x, pa.large_string()) for x in (_AS_IT_STANDS, ""))
    marked = pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", " \n"), nothing)
    words = pc.split_pattern(marked, " ")
    return words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _odd_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The same for any text: cut at every space that follows other text, each piece as it stands."""
    pieces, counts = [], []
    for text in texts:
        cuts = [m.start() for m in _SPACE_AFTER_TEXT.finditer(text)]
        found = [_AS_IT_STANDS + text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if text else []
        pieces += found
        counts.append(len(found))
    return pa.array(pieces, pa.large_string()), np.array(counts, np.int64)


@cache
def encoder(tokenizer_json: str, special_as_text: bool) -> TextEncoder:
    """The process's encoder of a vocabulary, kept over tasks together with its words."""
    # A task has one core; the library's threads would take those of others.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TextEncoder(tokenizer_json, special_as_text)


def read_tokenizer(path: str) -> str:
    """The vocabulary file's text, read once by the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()
