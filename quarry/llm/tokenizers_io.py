"""Pieces of whole texts by the library of a public tokenizer, word by word.

Where no piece can span an ASCII space, the pieces of a text are those of its words in turn. Words repeat, so each
worker keeps the pieces of words it has met, up to a fixed number. A word that differs from a known one only in ASCII
case, or by marks after a letter or digit, needs no call of the library. Texts are cut into words together, as Arrow
and numpy do it, so that only the distinct words of some megabytes are looked up.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a generation that a worker remembers, about; words it learns at once; words in a call of the library.
MEMO_WORDS, LEARN, CALL = 400_000, 60_000, 100
#: Bytes of texts, about, whose words are told apart together; a longer text is cut at spaces.
GROUP = 1 << 22
#: Marks that, at the end of a word after a letter or digit, are a pre-token of their own, however many.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands between words in a call; words that hold it are passed alone.
_GAP = b"\x01"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Kinds of bytes: spaces, marks, ASCII letters and digits, and all others.
_SPACES, _MARK, _ALNUM, _OTHER = range(4)
_KIND = bytes(_SPACES if i in b" \t\n\v\f\r" else _MARK if i in _MARKS else _ALNUM if i < 0x80 and chr(i).isalnum() else _OTHER for i in range(256))
#: Letters that no normalizer below changes, a-z and those of Latin-1, and the settings by which a run of them is one pre-token.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_LETTERS_WHOLE = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about GROUP bytes that begin at spaces."""
    at = 0
    while len(text) - at > GROUP and (space := _SPACE.search(text, at + GROUP)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


class WordEncoder:
    """Ids of words as little-endian 32-bit integers, by the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already use all cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {}])
        self.folds_case = any(p.get("type") == "Lowercase" for p in parts)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.bare, self.last = self._bare(spec, parts)
        self.gap = self.library.encode(_GAP.decode(), add_special_tokens=False).ids
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _bare(self, spec: dict, parts: list[dict]) -> tuple:
        """The library's tokenizer with the same model, for words of plain letters alone, and by id whether it ends a word."""
        from tokenizers import Tokenizer, pre_tokenizers

        model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers")
        suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not suffix or cut != [_LETTERS_WHOLE, _BYTES] or not all(p in _NORMALIZERS for p in parts):
            return None, None
        bare = Tokenizer(self.library.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = np.zeros(max(model["vocab"].values()) + 1, bool)
        last[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
        return bare, last

    def alone(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: bytes) -> bool:
        """Whether a text has neither a special string nor the gap."""
        return _GAP not in text and not any(s in text for s in self.special)

    def call(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        plain = list(filter(_LETTERS.fullmatch, words)) if self.bare else []
        known = dict(zip(plain, self._call_letters(plain), strict=True)) if plain else {}
        rest = [w for w in words if w not in known]
        if rest:
            known.update(zip(rest, self._call_any(rest), strict=True))
        return list(map(known.__getitem__, words))

    def _call_letters(self, words: list[bytes]) -> list[bytes]:
        """Words of plain letters need no normalizer and no pattern: each is a pre-token, and its last id tells that it ends."""
        out: list[bytes] = []
        lines = [words[i : i + CALL] for i in range(0, len(words), CALL)]
        for line, got in zip(lines, self.bare.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(line) or ends[-1] != 4 * len(ids):
                raise ValueError("the ends of words were not kept")
            out.extend(map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)))
        return out

    def _call_any(self, words: list[bytes]) -> list[bytes]:
        """Many words go in one call, with a gap between that has an id of its own."""
        out: list[bytes] = []
        lines = [words[i : i + CALL] for i in range(0, len(words), CALL)]
        texts = [(b" " + _GAP + b" ").join(x) for x in lines]
        if len(self.gap) != 1 or not self.plain(b"".join(words)):
            return list(map(self.alone, words))
        for line, got in zip(lines, self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            at = np.flatnonzero(ids == self.gap[0])
            if len(at) != len(line) - 1:
                raise ValueError("the gap between words was not kept")
            data = ids.tobytes()
            out.extend(map(data.__getitem__, map(slice, [0, *((at + 1) * 4).tolist()], [*(at * 4).tolist(), len(data)])))
        return out

    def learn(self, words: set[bytes]) -> None:
        """Remember these words. When a generation is full, it becomes the old one, from which words come back."""
        wanted, words = words, words.difference(self.memo)
        if len(self.memo) + len(words) > MEMO_WORDS:
            self.old, self.memo, words = self.memo, {}, wanted
        memo, old, marked, bare = self.memo, self.old, [], set()
        back = old.keys() & words
        memo.update(zip(back, map(old.__getitem__, back), strict=True))
        words = words - back
        if not self.plain(b" ".join(words)):
            odd = [w for w in words if not self.plain(w)]
            memo.update((w, self.alone(w)) for w in odd)
        for w in words:
            if w in memo:
                continue
            core = w.rstrip(_MARKS)
            if len(core) == len(w) or not core or not (chr(core[-1]).isalnum() if core[-1] < 0x80 else core.decode()[-1].lower()[-1].isalpha()):
                bare.add(w)
            else:
                marked.append((w, core, w[len(core) :]))
        for _, core, mark in marked:
            for part in (core, mark):
                if part not in memo:
                    if part in old:
                        memo[part] = old[part]
                    else:
                        bare.add(part)
        todo = list(bare)
        memo.update(zip(todo, self.call(todo), strict=True))
        for w, core, mark in marked:
            memo[w] = memo[core] + memo[mark]

    def encode(self, text: bytes) -> bytes:
        """The ids of a text."""
        return self.encode_all([text])[0]

    def recall(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        out: list[bytes] = []
        for i in range(0, len(words), LEARN):
            part = words[i : i + LEARN]
            self.learn(set(part))
            out.extend(map(self.memo.__getitem__, part))
        return out

    def group(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, of texts that are plain and in lower case where the tokenizer folds case."""
        data = b"\n".join([b"", *texts, b""])
        kind = np.frombuffer(data.translate(_KIND), np.uint8)
        run = np.flatnonzero(kind[1:] != kind[:-1]) + 1  # the first run and the last are spaces
        this, before, after = kind[run], kind[run - 1], kind[run[1:]]
        marks = (this[:-1] == _MARK) & (before[:-1] == _ALNUM) & (after == _SPACES)  # at a word's end: words of their own
        begins = (this != _SPACES) & (before == _SPACES)
        begins[:-1] |= marks
        edge = np.flatnonzero(begins | (this == _SPACES))
        word = np.flatnonzero(begins[edge])
        starts, ends = run[edge[word]], run[edge[word + 1]]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        solid = data.translate(None, b" \t\n\x0b\x0c\r")
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
        found = pa.array(self.recall(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, offsets, ids = found.buffers()
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])  # where texts begin, less one
        cuts = np.frombuffer(offsets, np.int64)[np.searchsorted(starts, bounds)].tolist()
        data = ids.to_pybytes() if ids else b""
        return list(map(data.__getitem__, map(slice, cuts[:-1], cuts[1:])))

    def apart(self, text: bytes) -> bytes:
        """The ids of a text that has a special string or the gap."""
        words = text.split()
        known = dict(zip(distinct := list(dict.fromkeys(words)), self.recall(distinct), strict=True))
        return b"".join(map(known.__getitem__, words))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held: list[bytes] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owners, size
            for i, got in zip(owners, self.group(held), strict=True):
                parts[i].append(got)
            held, owners, size = [], [], 0

        for i, text in enumerate(texts):
            low = text.lower() if self.folds_case else text
            if not self.plain(low):  # lower case could make a special string
                parts[i].append(self.apart(text))
                continue
            for piece in _pieces(low):
                held.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= GROUP:
                    flush()
        if held:
            flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in parts]

    def counts(self, words: list[bytes]) -> list[int]:
        """Numbers of ids of distinct words."""
        return [len(x) // 4 for x in self.call(words)]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        gc.set_threshold(50_000, 20, 20)  # memories of words hold no cycles, and are slow to go through
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
