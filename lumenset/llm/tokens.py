"""Token ids of whole texts by a public tokenizer file, with a cache by word."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that are encoded in one string. Longer strings are slower for each piece.
TOGETHER = 50
_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, which serves all its tasks."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]


class WordTokenizer:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, the same as ``encode`` of the whole text gives.

    The file's splitting rule puts a boundary before a single space, and on both sides of a single line feed, where no
    other white space touches them, and no merge crosses a boundary. So a text is cut there and its pieces are looked
    up; pieces not seen before go to the library, many in one string. A text in which two white-space characters touch
    goes to the library whole, and so does one that has a special token's string, which is that token there. At ``limit``
    pieces, or ``most_bytes`` of pieces and ids, the later half of the cache goes; the pieces met first are the common ones.
    Pieces of more than ``longest`` characters aren't kept.
    """

    def __init__(self, path: str, limit: int = 600_000, most_bytes: int = 64_000_000, longest: int = 256):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.model._resize_cache(0)
        self.limit, self.most_bytes, self.longest, self.held = limit, most_bytes, longest, 0
        self.special = "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.spaced = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, i in self.tok.get_vocab().items():
            self.spaced[i] = token.startswith("Ġ")
        self.line = np.zeros_like(self.spaced)
        self.line[self.tok.encode("\n", add_special_tokens=False).ids] = True
        self.mark = {c: self._whole(c) for c in ".,!?;:"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """pieces begin with a line feed, or stand for themselves after a space."""
        known, marks = self.known, self.mark
        stems = {}  # letters and then one mark are two tokens' texts at least
        for p in pieces:
            if p[-1] in marks and (stem := p[:-1]).isalpha() and max(stem) < "\u0250":
                stems[p] = stem
        own = dict.fromkeys(stems.get(p, p) for p in pieces)
        for lines in (True, False):
            own_here = [p for p in own if (p[0] == "\n") == lines and p not in known]
            groups = [own_here[i : i + TOGETHER] for i in range(0, len(own_here), TOGETHER)]
            texts = ["".join(g) if lines else " " + " ".join(g) for g in groups]
            for group, found in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype="<u4")
                starts = np.flatnonzero((self.line if lines else self.spaced)[ids])
                if len(starts) == len(group):
                    cut, all_ids = [*(4 * starts).tolist(), 4 * len(ids)], ids.tobytes()
                    known.update((p, all_ids[cut[i] : cut[i + 1]]) for i, p in enumerate(group))
                else:  # a mark within a piece: each by itself
                    known.update((p, self._whole(p if lines else " " + p)) for p in group)
        known.update((p, known[stem] + marks[p[-1]]) for p, stem in stems.items())

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one more: the end). Null: no ids."""
        if len(self.known) > self.limit or self.held > self.most_bytes:
            self.known = dict(islice(self.known.items(), len(self.known) // 2))
            self.held = sum(len(p) + len(x) for p, x in self.known.items())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(*(pa.scalar(x, texts.type) if isinstance(x, str) else x for x in ("\n", texts, ""))), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        code, ends = coded.indices.to_numpy(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # each text's first piece is the empty one before the line feed put in front of it
        known = list(map(self.known.get, pieces))
        before = sum(len(x) for x in known if x is not None)
        new = [p for p, x in zip(pieces, known, strict=True) if x is None]
        bad = {p for p in new if _touching(p)}
        self._learn([p for p in new if p not in bad] if bad else new)
        known = [self.known.get(p, b"") if x is None else x for p, x in zip(pieces, known, strict=True)]
        self.held += sum(len(p) for p in new) + sum(len(x) for x in known) - before
        for p in [p for p in new if len(p) > self.longest]:
            self.held -= len(p) + len(self.known.pop(p, b""))
        pool, size = np.frombuffer(b"".join(known), dtype="<u4"), np.array([len(x) // 4 for x in known], dtype=np.int64)
        first = np.cumsum(size) - size
        n = size[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(upto[-1]) + np.repeat(first[code] - upto[:-1], n)]
        starts = upto[ends]
        whole = np.zeros(len(texts), dtype=bool)
        if self.special:
            whole = pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        if bad:
            is_bad = np.array([p in bad and p != "" for p in pieces])[code]
            empty = np.flatnonzero(np.array([p == "" for p in pieces])[code])
            is_bad[np.setdiff1d(empty, ends[:-1])] = True
            seen = np.concatenate([[0], np.cumsum(is_bad)])
            whole = whole | (seen[ends[1:]] > seen[ends[:-1]])
        if not whole.any():
            keep = np.ones(len(ids), dtype=bool)
            keep[starts[:-1]] = False  # the line feed put in front
            return ids[keep], starts - np.arange(len(starts))
        parts = [
            np.frombuffer(self._whole(texts[k].as_py()), dtype="<u4") if whole[k] else ids[starts[k] + 1 : starts[k + 1]]
            for k in range(len(texts))
        ]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def _touching(piece: str) -> bool:
    """The piece begins or ends with white space, or is empty, so that white space touches white space."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return not body or body[0].isspace() or body[-1].isspace()
