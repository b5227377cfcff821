"""Byte-pair encoders that give the ids of the ``tokenizers`` library, faster than its own calls.

Both supported files are plain byte-pair vocabularies: ids follow merge order, so a rank table
gives the same merges. Texts the rank table is not proven on (special strings, characters outside
``PLAIN``) go to the library itself, so ids never depend on which path ran.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split patterns stated in the two tokenizer files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters whose classes (letter, number, space) and case are the same in all libraries in use.
PLAIN = re.compile(r"[^\t-\r -~\xa1-ɏ‐-‧‰-⁞€]")
#: Spaces other than a blank and a line feed.
SPACES = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0]")
#: Characters of texts whose chunks are put together at a time: bounds what a worker holds beside its batch.
GROUP = 2 << 20
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
#: The same patterns for ``PLAIN`` texts, with the classes written out.
BYTE_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\t-\r {_L}{_N}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_BLANKS = re.compile("  +")
#: What the word pattern parts from a run of letters, which is all that lies between.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\t-\r {_L}{_N}]+")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins byte-level vocabularies use for the 256 byte values."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """ids of one tokenizer file; made once per Python worker (:func:`encoder`)."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = model["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        kind, pre = self._kind(spec), _byte_of()
        self.kind = kind
        self.ranks = None
        if kind == "byte":
            ranks = {bytes(pre[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.ranks = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={"\0": self.size})
        elif kind == "word":
            # A blank marks the end of a word: blanks are never part of one, so the byte is free.
            ranks = {}
            for t, i in vocab.items():
                end = len(t) > 4 and t.endswith("</w>")
                raw = bytes(pre[c] for c in (t[:-4] if end else t))
                if b" " not in raw:
                    ranks[raw + b" " * end] = i
            for b in range(256):
                ranks.setdefault(bytes([b]), (1 << 20) + b)
            self.ranks = tiktoken.Encoding("word", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={"\0": self.size})

    @staticmethod
    def _kind(spec: dict) -> str:
        """Which known layout the file has; anything else is left to the library."""
        model, pre, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges")
        ordered = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in spec["added_tokens"])
        if not plain or not ordered or spec["post_processor"]:
            return "library"
        if pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and norm is None and not model["end_of_word_suffix"]:
            return "byte"
        if pre.get("type") == "Sequence" and model["end_of_word_suffix"] == "</w>" and norm:
            split, level = pre["pretokenizers"][0], pre["pretokenizers"][-1]
            kinds = [n["type"] for n in norm.get("normalizers", [])]
            if split.get("pattern", {}).get("Regex") == WORD_PATTERN and not level["use_regex"] and kinds == ["NFC", "Replace", "Lowercase"]:
                return "word"
        return "library"

    def plain(self, text: str) -> bool:
        """Whether the rank table is proven to give the library's ids for ``text``."""
        if self.ranks is None or any(s in text for s in self.special):
            return False
        if text.isascii():
            return "\0" not in text and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
        return not PLAIN.search(text)

    def encode(self, text: str) -> np.ndarray:
        """The ids of one whole text, without added special tokens."""
        return np.frombuffer(self.encode_all([text])[0], self.dtype)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, packed as little-endian ``dtype``.

        Plain texts are cut at blanks, which no merge crosses; the ids of each distinct chunk of
        these texts are made once and put together by number. Nothing is kept between calls.
        """
        out: list = [None] * len(texts)
        at: list[int] = []
        marked: list[str] = []
        for k, text in enumerate(texts):
            own = self._marked(text)
            if own is not None:
                at.append(k)
                marked.append(own)
            elif self.kind == "byte" and self.plain(text):
                out[k] = self.ranks.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()
            else:
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        ends = np.cumsum([0, *map(len, marked)])
        first = 0
        while first < len(marked):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + GROUP, "right")) - 1)
            for k, ids in zip(at[first:last], self._joined(marked[first:last])):
                out[k] = ids
            first = last
        return out

    def _marked(self, text: str) -> str | None:
        """A plain text with a NUL between chunks that are encoded apart; None if it is to be read whole."""
        if not self.plain(text):
            return None
        if self.kind == "word":
            low = text.lower()
            return "\0".join(low.split()) if low.isascii() or not PLAIN.search(low) else None
        if "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text.endswith(("\n\n", " ")) or not text or SPACES.search(text):
            return None
        return text.replace("\n", "\0\n").replace(" ", "\0 ")

    def _joined(self, marked: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        chunks = split.flatten().dictionary_encode()
        number = chunks.indices.to_numpy()
        ids, ends = self._ids(chunks.dictionary)
        size = np.diff(ends, prepend=0)
        width = size[number]
        stop = np.cumsum(width)
        place = np.repeat((ends - size)[number] - stop + width, width)
        place += np.arange(len(place))
        raw = ids[place].tobytes()
        bounds = np.concatenate([[0], stop])[split.offsets.to_numpy()] * self.dtype.itemsize
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after another, and where each chunk's end."""
        if self.kind == "byte":
            parts = "\0".join(chunks.to_pylist()) + "\0"
        else:  # every pre-token ends with a blank, every chunk with a NUL
            parts = _PIECE.sub(r" \g<0> ", " \n".join(chunks.to_pylist()) + " \n")
            parts = _BLANKS.sub(" ", parts).replace(" \n", " \0").replace("\0 ", "\0")
        ids = self.ranks.encode_to_numpy(parts, allowed_special={"\0"})
        marks = np.flatnonzero(ids == self.size)
        return ids[ids != self.size].astype(self.dtype), marks - np.arange(len(marks))

    def pretokens(self, text: str) -> list[str]:
        """The pieces the merges work on; special strings, which count as one id, are left out."""
        if self.kind == "byte" and self.plain(text):
            return BYTE_SPLIT.findall(text)
        out = []
        for part in re.split("|".join(map(re.escape, self.special)), text) if self.special else [text]:
            norm = self.library.normalizer
            part = norm.normalize_str(part) if norm else part
            if part:
                split = self.library.pre_tokenizer.pre_tokenize_str(part)
                out += [part[a:b] for _, (a, b) in split]
        return out

    def specials(self, text: str) -> int:
        return len(re.findall("|".join(map(re.escape, self.special)), text)) if any(s in text for s in self.special) else 0

    def count(self, pieces: list[str]) -> list[int]:
        """How many ids each pre-token makes."""
        if self.kind == "byte":
            return [
                len(self.ranks.encode_ordinary(p)) if self.plain(p) else len(self.library.encode(p, add_special_tokens=False).ids)
                for p in pieces
            ]
        return [len(self.library.encode(p, add_special_tokens=False).ids) for p in pieces]


_made: dict[str, Bpe] = {}


def encoder(path: str) -> Bpe:
    if path not in _made:
        _made[path] = Bpe(path)
    return _made[path]


def default_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine (resolved on each executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)
