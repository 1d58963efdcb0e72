"""Token ids of a public tokenizer, for whole texts, inside Spark tasks.

All ids come from the `tokenizers` library. Texts are cut before single spaces, where the pre-tokenizer cuts too, and each
distinct word of a batch is cut further into runs of Latin letters and of other ASCII characters. Every distinct run is
encoded once per Python worker, and the ids of a text are put together with numpy. Words with apostrophes, white space in
a row or other characters, where the further cuts could differ from the pre-tokenizer's, are encoded as they are; texts
with spaces beside other white space, with very long words of that kind, or in which one of the tokenizer's special tokens
is spelled out, are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ROW = re.compile(r"\s\s")
_FAR = re.compile(rf"[^\x00-\x7f{_LETTER}]")
_PLAIN = rf"^[!-&(-~{_LETTER}]+$"
_RUNS = re.compile(rf" ?[{_LETTER}]+| ?[^{_LETTER} ]+| ")
#: Runs that a worker remembers at once; a full memory is emptied, which changes no result.
MEMORY = 1_200_000
#: Characters of text after which a group of texts is encoded.
GROUP = 4_000_000
#: Words that are not cut further are remembered up to this length.
LONG = 200


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode(texts) gives one uint32 array per text; null texts are empty."""

    def __init__(self, path: str, memory: int = MEMORY):
        import os

        self.memory = memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint16)
        self.used = 0
        self.start = np.zeros(1 << 16, dtype=np.int32)
        self.size = np.zeros(1 << 16, dtype=np.int32)

    def _learn(self, words: list[str]) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            ids = [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
            lens = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            total, at = int(lens.sum()), len(self.place)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while at + len(part) > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), dtype=np.uint16, count=total)
            self.start[at : at + len(part)] = self.used + np.cumsum(lens) - lens
            self.size[at : at + len(part)] = lens
            self.used += total
            self.place.update(zip(part, range(at, at + len(part)), strict=True))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        group: list[str] = []
        n = 0
        for t in texts:
            group.append(t or "")
            n += len(group[-1])
            if n > GROUP:
                out += self._encode_group(group)
                group, n = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts; what each distinct word of them needs is done once."""
        if not texts:
            return []
        parts = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
        starts = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(words, _PLAIN)
        known = words.filter(plain)
        other = words.filter(pc.invert(plain)).to_pylist()
        joined = pc.binary_join_element_wise(pa.scalar(" ", known.type), known, pa.scalar("", known.type))
        runs = _RUNS.findall(str(joined.buffers()[2] or b"", "utf-8")) if len(joined) else []  # each word with its space
        begins = np.flatnonzero(np.fromiter((r[0] == " " for r in runs), dtype=bool, count=len(runs)))
        n_runs = [np.diff(begins, append=len(runs))]
        whole = np.zeros(len(other), dtype=bool)  # words that send their texts through the library as they are
        for k, w in enumerate(other):
            cut = self._cut(" " + w) if w and not w[0].isspace() and not w[-1].isspace() else None
            whole[k] = cut is None
            runs += cut or []
            n_runs.append([len(cut or [])])
        direct = np.zeros(len(texts), dtype=bool)
        for k, t in enumerate(texts):  # first words have no space before them
            cut = self._cut(t if (end := t.find(" ")) < 0 else t[:end])
            direct[k] = cut is None or self.special is not None and self.special.search(t) is not None
            runs += cut or []
            n_runs.append([len(cut or [])])
        number = np.empty(len(words), dtype=np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        number[plain], number[~plain] = np.arange(len(known)), len(known) + np.arange(len(other))
        if whole.any():
            whole = np.concatenate([np.zeros(len(known), dtype=bool), whole])[number[code]]
            whole[starts[:-1]] = False
            direct |= np.logical_or.reduceat(whole, starts[:-1])
        code = number[code]
        code[starts[:-1]] = len(words) + np.arange(len(texts))
        n_runs = np.concatenate(n_runs)
        flat, size = self._ids(runs)
        ends = np.concatenate([[0], np.cumsum(size)])
        unit_ends = ends[np.cumsum(n_runs)]
        unit_size = np.diff(unit_ends, prepend=0)
        size = unit_size[code]
        ends = np.cumsum(size)
        ids = flat[np.repeat((unit_ends - unit_size)[code] - ends + size, size) + np.arange(ends[-1])].astype(np.uint32)
        out = np.split(ids, ends[starts[1:-1] - 1])
        for k in np.flatnonzero(direct):
            out[k] = np.array(self.tok.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids, dtype=np.uint32)
        return out

    def _cut(self, unit: str) -> list[str] | None:
        """A word cut into runs; None if it is long and can't be cut."""
        if "'" in unit or _ROW.search(unit) or not unit.isascii() and _FAR.search(unit):
            return [unit] if len(unit) <= LONG else None
        return _RUNS.findall(unit)

    def _ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs one after the other, and the number of ids of each."""
        k = np.fromiter(map(self.place.get, runs, repeat(-1)), dtype=np.int32, count=len(runs))
        missing = np.flatnonzero(k < 0)
        if len(missing):
            new = list({runs[i] for i in missing})
            if len(self.place) + len(new) > self.memory:
                self._forget()
                missing, new = range(len(runs)), list(set(runs))
            self._learn(new)
            k[missing] = [self.place[runs[i]] for i in missing]
        size = self.size[k].astype(np.int64)
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[k] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memory: int = MEMORY) -> Encoder:
    """One for each path and Python worker."""
    if (path, memory) not in _ENCODERS:
        _ENCODERS[path, memory] = Encoder(path, memory)
    return _ENCODERS[path, memory]
