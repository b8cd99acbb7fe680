"""A byte-level BPE vocabulary file, run by the fastest library that gives the same ids."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the split pattern that byte-level BPE files of this kind imply with use_regex.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranges of letters (Latin, Greek, Cyrillic, kana, Han, Hangul) and of marks that have long been assigned.
LETTERS = [("À", "ɏ"), ("α", "ω"), ("А", "я"), ("ぁ", "ゖ"), ("ァ", "ヺ"), ("一", "龥"), ("가", "힣")]
OTHERS = [("、", "〃"), ("〈", "】"), ("！", "／"), ("：", "＠")]
#: Runs up to this length are safe for the fast library, whose merge loop is quadratic in a run.
SAFE_RUN = 512


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Engine:
    """Encodes like ``Tokenizer.from_file(path)`` without special tokens added, truncation or padding.

    Ordinary texts go through tiktoken with ranks read from the same file, if the file's merges
    are in the order of its ids; texts with very long runs without (or of) white space, and files
    of any other kind, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.fast = self._fast(spec)
        self.widest = max(map(len, self.specials), default=0)

    def _fast(self, spec: dict) -> tiktoken.Encoding | None:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens") or [])
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec.get("normalizer") or spec.get("post_processor") or model.get("type") != "BPE" or not plain:
            return None
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in self.specials}
        ids = model["vocab"]
        made = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in made or any(b <= a for a, b in zip(made, made[1:])) or len(ranks) != 256 + len(made):
            return None
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=self.specials)

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            words = text.split()
            sizes = sum(map(len, words))
            if len(text) - sizes - len(words) < SAFE_RUN and max(map(len, words), default=0) < SAFE_RUN:
                return self.fast.encode(text, allowed_special="all")
        return self.library.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        if self.fast is not None:
            return self.fast.decode_bytes(ids).decode("utf-8", "replace")
        return self.library.decode(ids, skip_special_tokens=False)

    @property
    def lengths(self) -> np.ndarray:
        """Bytes of each token's text, for offsets."""
        if not hasattr(self, "_lengths"):
            alphabet = byte_alphabet()
            sizes = np.zeros(self.library.get_vocab_size(), dtype=np.int64)
            for token, i in self.library.get_vocab(with_added_tokens=True).items():
                sizes[i] = len(token.encode()) if token in self.specials else sum(1 for c in token if c in alphabet)
            self._lengths = sizes
        return self._lengths


    def is_joint(self, text: str, at: int) -> bool:
        """Whether a piece of ``text``, begun anywhere before ``at``, always ends at ``at``; ``text`` is all there is.

        Besides the places that ``is_joint`` names: between letters, digits and other characters, as no
        piece of the split pattern holds two of these kinds but an apostrophe with letters after it;
        not within a token that is matched as a whole string.
        """
        if is_joint(text, at):
            return True
        if self.fast is None or not 0 < at < len(text):
            return False
        before, after = kind(text[at - 1]), kind(text[at])
        if not before or not after or before == after or (text[at - 1] == "'" and after == "L"):
            return False
        return not any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in self.specials)


def kind(c: str) -> str:
    """L, N or O (neither) for characters of which all libraries say so, else nothing."""
    if c < "\x7f":
        return "L" if c.isalpha() else "N" if c.isdigit() else "O" if c > " " else ""
    if any(a <= c <= b for a, b in LETTERS) and c not in "×÷":
        return "L"
    return "O" if any(a <= c <= b for a, b in OTHERS) else ""


@lru_cache(maxsize=4)
def engine(path: str) -> Engine:
    """One engine for each file in a process."""
    return Engine(path)


def is_joint(text: str, at: int) -> bool:
    """Whether every scan of ``text``, begun anywhere before ``at``, has a piece boundary at ``at``.

    A piece of the split pattern has white space only at its start or throughout, and the tokens
    that are matched as whole strings hold none, so the place between a non-space character and
    a white-space character is a boundary whatever stands before or after. Only the four
    characters that all libraries take for white space count at ``at``.
    """
    return 0 < at < len(text) and text[at] in " \n\t\r" and not text[at - 1].isspace()
