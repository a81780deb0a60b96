"""Exact, cached encoding of many texts with a byte-level BPE file of the ``tokenizers`` library.

The library's pattern cuts a text into pieces and encodes each alone. These cuts are always among its
own, whatever stands around them:

* before a single space between two characters that are not white space (the space goes to what
  comes after it), and around a single newline between two such characters;
* between a Latin letter and one of ``PUNCTUATION`` (a run of letters ends there).

A batch of texts is cut at spaces (by Arrow, in one call) into words, distinct words are cut into
pieces, and the ids of texts are gathered from those of the pieces, which a worker keeps in a bounded
table. All new pieces of a batch go to the library joined into one text, whose ids are dealt to the
pieces by the bytes that they stand for.

The result equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` for every text. These
texts go to the library whole: with two spaces in a row, with a space beside other white space, with
white space at either end, and those that hold the string of an added token (such as
``<|endoftext|>``), which the library gives that token's id; with ``special_as_text`` such strings
count as ordinary text, as by ``Tokenizer.encode_special_tokens``.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PUNCTUATION = ".,;:!?*$%&#|"
_PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\n " + re.escape(PUNCTUATION) + r"]|\Z)| ?[^\n ]+|\n")

#: Pieces that a worker keeps at most, but for those of one chunk; then the table is emptied.
CACHE_PIECES = 1_000_000
#: Bytes of text that are encoded at once, but for a longer single text.
CHUNK = 1 << 23
#: Pieces that go to the library at once.
JOINED = 1 << 14

#: White space for Python, or for any version of Unicode that the library may follow.
_EXTRA = "\x1c-\x1f\x85\u180e\u200b\u2060\ufeff"
_BLANK = frozenset(c for c in map(chr, range(0x10000)) if re.match(rf"[\s{_EXTRA}]", c))
#: A word with white space inside, other than single newlines, is one piece.
_ODD = re.compile(rf"\n\n|[^\S\n ]|[{_EXTRA}]")


class CachedEncoder:
    """``encode_many(texts)`` gives the ids of texts as one array, and where each text's ids end."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (special_as_text and t.special)]
        # a letter of a byte-level vocabulary stands for one byte
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token)
        self.max_pieces = pieces
        self._clear()

    def _clear(self) -> None:
        #: Place of each known piece in ``ends``; ids of all of them one after another.
        self.pieces: dict[str, int] = {}
        self.ends = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _joined(self, pieces: list[str], mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and their number by piece; each is cut from what precedes it by ``mark``
        (a newline, or nothing before a space)."""
        ids = np.array(self.tokenizer.encode_batch_fast([mark + mark.join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        size = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        ends = np.cumsum(size + len(mark))
        token_ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
        first, last = np.searchsorted(token_ends, ends - size), np.searchsorted(token_ends, ends)
        if np.array_equal(token_ends[first], ends - size) and np.array_equal(token_ends[np.minimum(last, len(ids))], ends):
            return (np.delete(ids, first - 1) if mark else ids), last - first
        alone = [self._plain(p) for p in pieces]  # a token across a cut, which the pattern rules out
        return np.concatenate(alone), np.array([len(x) for x in alone], np.int64)

    def _learn(self, new: list[str]) -> None:
        spaced, bare, blank = [], [], []
        for p in new:
            (spaced if p[0] == " " else blank if p[0] in _BLANK else bare).append(p)
        found = [(ids, np.array([len(ids)])) for ids in map(self._plain, blank)]
        for pieces, mark in ((spaced, ""), (bare, "\n")):
            found += [self._joined(pieces[at : at + JOINED], mark) for at in range(0, len(pieces), JOINED)]
        at = len(self.pieces)
        self.pieces.update(zip([*blank, *spaced, *bare], range(at, at + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, *[ids for ids, _ in found]])
        self.ends = np.cumsum(np.concatenate([np.diff(self.ends, prepend=0), *[n for _, n in found]]))

    def _cut(self, words: list[str], before: str) -> tuple[list[str], np.ndarray]:
        """Pieces of words with ``before`` (a space or nothing) in front, and their number by word."""
        joined = " " + " ".join(words)
        if before and words and not _ODD.search(joined):
            flat = _PIECES.findall(joined)
            first = np.fromiter((p[0] == " " for p in flat), bool, len(flat))
            return flat, np.diff(np.flatnonzero(first), append=len(flat))
        cut = [(before + w,) if _ODD.search(w) else _PIECES.findall(before + w) for w in words]
        return [p for c in cut for p in c], np.fromiter(map(len, cut), np.int64, len(cut))

    def _ids_of(self, words: list[str], heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words after a space, then of such at the start of a text, and their number by word."""
        flat, n = self._cut(words, " ")
        more, m = self._cut(heads, "")
        flat += more
        known = list(map(self.pieces.get, flat))
        if None in known:
            new = {p for p, k in zip(flat, known, strict=True) if k is None}
            if len(self.pieces) + len(new) > self.max_pieces:
                self._clear()
                new = set(flat)
            self._learn(list(new))
            known = list(map(self.pieces.__getitem__, flat))
        piece = np.array(known, np.int64)
        ids, ends = _gather(self.ids, self.ends, piece)
        count = np.concatenate([n, m])
        words_end = np.concatenate([[0], ends])[np.cumsum(count)]
        return ids, np.diff(words_end, prepend=0)

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of texts; null and empty ones have no ids."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)  # texts that are not cut
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts, " ")
        starts = cut.offsets.to_numpy().astype(np.int64)
        starts, last = starts[:-1] - starts[0], starts[1:] - starts[0] - 1
        coded = cut.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        # a text's first word has no space before it
        heads, head = np.unique(index[starts], return_inverse=True)
        others = np.ones(len(index), bool)
        others[starts] = False
        used = np.zeros(len(words), bool)
        used[index[others]] = True
        index = (np.cumsum(used) - 1)[index]
        index[starts] = used.sum() + head
        distinct = [*words[used].tolist(), *words[heads].tolist()]
        unsafe = [i for i, w in enumerate(distinct) if not w or w[0] in _BLANK or w[-1] in _BLANK]
        if unsafe:
            flags = np.zeros(len(distinct), bool)
            flags[unsafe] = True
            whole |= np.logical_or.reduceat(flags[index], starts)
            for i in unsafe:
                distinct[i] = "x"  # anything; its texts go to the library
        k = int(used.sum())
        pool, length = self._ids_of(distinct[:k], distinct[k:])
        ids, ends = _gather(pool, np.cumsum(length), index)
        ends = ends[last]
        if not whole.any():
            return ids, ends
        parts, before = [], 0
        for i, (end, alone) in enumerate(zip(ends.tolist(), whole.tolist(), strict=True)):
            parts.append(self._plain(texts[i].as_py()) if alone else ids[before:end])
            before = end
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_many(pa.array([text], pa.string()))[0].tobytes()

    def encode_batch(self, texts: pa.Array, chunk: int = CHUNK) -> Iterator[bytes]:
        """Ids of each text of a batch, encoded in chunks of bounded size."""
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // chunk
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for i, j in zip(cuts, cuts[1:], strict=False):
            ids, ends = self.encode_many(texts.slice(i, j - i))
            data, before = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                yield data[before:end]
                before = end


def _gather(pool: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``pool`` (each up to its place in ``ends``) in the order of ``index``, and where they end."""
    length = np.diff(ends, prepend=0)[index]
    out = np.cumsum(length)
    step = np.repeat(ends[index] - out, length)
    step += np.arange(len(step))
    return pool[step], out


@functools.lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = False) -> CachedEncoder:
    """One encoder per Python worker and file, kept between tasks."""
    return CachedEncoder(path, special_as_text=special_as_text)
