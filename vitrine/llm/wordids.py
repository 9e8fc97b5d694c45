"""Ids of texts by a word-level tokenizer file, equal chunks encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose texts are encoded together (see ``bpe.slices``).
SLICE = 8_000_000
#: Marks that end a word; a run of them is a pre-token of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_JOINED = 100
#: Characters beyond the Latin letters whose lower case and normal form are plain (not so: dotted capital I).
_OTHER = re.compile("[^\x00-įı-ɏ]")


class WordIds:
    """Ids of texts by a tokenizer that drops white space and ends each
    pre-token by a ``</w>`` token, so that space-separated chunks encode
    independently of each other and of ASCII case.  The different chunks of a
    call are encoded once.  Lower-case Latin words go through the tokenizer's
    model alone, in groups, marks behind a word apart from it; all others, and
    groups whose words don't come out one by one, through the whole tokenizer.
    Nothing is kept between calls."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by the whole tokenizer."""
        out = []
        for lo in range(0, len(texts), 20_000):
            found = self.tokenizer.encode_batch_fast(texts[lo:lo + 20_000], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4") for e in found]
        return out

    def _by_model(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of lower-case words, number of ids of each)."""
        parts, sizes = [], []
        for lo in range(0, len(words), 100 * _JOINED):
            groups = [words[i:i + _JOINED] for i in range(lo, min(lo + 100 * _JOINED, len(words)), _JOINED)]
            found = self.words.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
            for group, e in zip(groups, found, strict=True):
                ids = np.array(e.ids, dtype="<u4")
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(group):
                    parts.append(ids)
                    sizes.append(np.diff(stops, prepend=0))
                else:
                    own = self._whole(group)
                    parts += own
                    sizes.append(np.array([len(x) for x in own]))
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none.astype("<u4"), *parts]), np.concatenate([none, *sizes])

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of different chunks without spaces, ASCII
        letters lower: two stretches of the ids for each chunk."""
        def simple(some: list[str]) -> list[bool]:
            """Which are lower-case words that the model can take as they are."""
            out = [a and b for a, b in zip(map(str.isalpha, some), map(str.islower, some), strict=True)]
            if _OTHER.search(" ".join(some)):
                out = [s and not _OTHER.search(t) for s, t in zip(out, some, strict=True)]
            return out
        plain = np.array(simple(chunks), dtype=bool)
        word_at, rest_at = np.flatnonzero(plain), np.flatnonzero(~plain)
        rest = [chunks[i] for i in rest_at.tolist()]
        bodies = [t.rstrip(_MARKS) for t in rest]
        split = np.array(simple(bodies), dtype=bool)
        pair_at, other_at = rest_at[split], rest_at[~split]
        pairs = [(b, t[len(b):]) for b, t, s in zip(bodies, rest, split.tolist(), strict=True) if s]
        # places of words and of the bodies that are no word of their own
        place = dict(zip((w := [chunks[i] for i in word_at.tolist()]), range(len(w)), strict=True))
        body = [place.setdefault(b, len(place)) for b, _ in pairs]
        mark_place: dict[str, int] = {}
        mark = [mark_place.setdefault(m, len(mark_place)) for _, m in pairs]
        ids, size = self._by_model(list(place))
        more = self._whole([*mark_place, *(chunks[i] for i in other_at.tolist())])
        size = np.concatenate((size, np.array([len(x) for x in more], dtype=np.int64)))
        start = np.cumsum(size) - size
        both = np.full((len(chunks), 2), -1)  # places of the stretches; -1: none
        both[word_at, 0] = np.arange(len(word_at))
        both[pair_at, 0], both[pair_at, 1] = body, np.array(mark, dtype=np.int64) + len(place)
        both[other_at, 0] = np.arange(len(other_at)) + len(place) + len(mark_place)
        return np.concatenate([ids, *more]), np.where(both < 0, 0, start[both]), np.where(both < 0, 0, size[both])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their number in each text)."""
        special = [i for i, t in enumerate(texts) if "<|" in t]  # may be a special token, whose case matters
        plain = not _OTHER.search("\n".join(texts))
        cut = [(t.lower().encode() if plain else t.encode().lower()).replace(b"\n", b" ") for t in texts]
        for i in special:
            cut[i] = b""
        lists = pc.split_pattern(pa.array(cut, pa.binary()).cast(pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        chunks = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        ids, starts, sizes = self._chunks(chunks.split(" "))
        code = coded.indices.to_numpy()
        n = sizes[code].ravel()
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts[code].ravel() - (ends - n), n) + np.arange(int(ends[-1]))]
        per = np.diff(np.concatenate(([0], ends[1::2]))[lists.offsets.to_numpy()])
        if special:
            parts = np.split(flat, np.cumsum(per)[:-1])
            for i in special:
                parts[i] = self._whole([texts[i]])[0]
            flat, per = np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        return flat, per

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        flat, per = self.encode_flat(texts)
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(per)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
