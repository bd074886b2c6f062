"""Ids of words met before, in a table of bounded size."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import regex

# Words of each of two generations: about 80 MB each in a worker.
WORDS_KEPT = 400_000
# Longer words are encoded each time they occur.
LONGEST_KEPT = 64
# str.split() parts at these four, which are no white space to tokenizers.
SEPARATORS = "\x1c\x1d\x1e\x1f"

# ASCII characters that are no letter, digit or white space.
MARKS = string.punctuation
# Letters up to here are composed, and have one lower case, in every version of Unicode.
LAST_PLAIN = "\xff"


def words_of(text: str) -> list[str]:
    """Runs without Unicode white space."""
    if any(c in text for c in SEPARATORS):
        return regex.findall(r"\S+", text)
    return text.split()


def letters_apart(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases text and parts letters from the marks behind them,
    with accents left on their letters and no added token of letters and such marks."""
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = {s.get("type") for s in normalizer.get("normalizers", [normalizer])}
    splits = [s for s in splitter.get("pretokenizers", [splitter]) if s.get("type") == "Split"]
    patterns = [s["pattern"].get("Regex", "").split("|") for s in splits]
    added = [token["content"] for token in spec.get("added_tokens") or []]
    return (
        "Lowercase" in steps
        and not steps & {"NFD", "NFKD", "StripAccents"}
        and any(r"[\p{L}]+" in parts and r"[^\s\p{L}\p{N}]+" in parts for parts in patterns)
        and not any(regex.fullmatch(r"\p{L}+[^\s\p{L}\p{N}]*", content) for content in added)
    )


# What a splitter's pattern may consist of if no match is to hold white space.
WORD_PARTS = {r"[\p{L}]+", r"[\p{N}]", r"[\p{N}]+", r"[^\s\p{L}\p{N}]+"}
PLAIN_STEPS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}


def words_apart(spec: dict) -> bool:
    """Whether a tokenizer file drops white space before it splits, as far as its settings show
    it: then a text's ids are those of its words, one after the other."""
    normalizer, splitter = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer]) if normalizer else []
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    first = splitter.get("pretokenizers", [splitter])[0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    parts = first["pattern"].get("Regex", " ").split("|")
    added = [token["content"] for token in spec.get("added_tokens") or []]
    return (
        all(s.get("type") in PLAIN_STEPS or s == blank for s in steps)
        and all(p in WORD_PARTS or p.lstrip("'").isalnum() for p in parts)
        and not any(regex.search(r"\s", content) for content in added)
    )


def core_and_mark(word: str) -> tuple[str, str]:
    """A plain word in lower case and the marks behind it, if that is all there is."""
    body = word.rstrip(MARKS)
    if body.isalpha() and (body.isascii() or max(body) <= LAST_PLAIN):
        return body.lower(), word[len(body) :]
    return word, ""


class WordTable:
    """Joins the ids of a text's words. A full generation becomes the old one and the one
    before is let go, so frequent words stay known and memory is bounded on any text.

    With ``apart``, for files of which `letters_apart` holds, the forms of a word that differ
    in case or by marks at the end share its ids.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[bytes]], apart: bool = False, kept: int = WORDS_KEPT):
        self.encode = encode
        self.apart = apart
        self.kept = kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _known(self, words: Iterable[str]) -> tuple[dict[str, bytes | None], list[str]]:
        """Ids of ``words``, with nothing for those that no generation holds; and these."""
        young, old = self.young, self.old
        found = {word: young.get(word) for word in words}
        unknown = []
        for word in [w for w, ids in found.items() if ids is None]:
            ids = old.get(word)
            if ids is None:
                unknown.append(word)
            else:
                found[word] = young[word] = ids
        return found, unknown

    def _add(self, found: dict[str, bytes | None], words: list[str], coded: Sequence[bytes]) -> None:
        found.update(zip(words, coded))
        self.young.update((w, ids) for w, ids in zip(words, coded) if len(w) <= LONGEST_KEPT)

    def _new(self, words: list[str]) -> Sequence[bytes]:
        if not self.apart:
            return self.encode(words)
        parts = list(map(core_and_mark, words))
        known, unknown = self._known(set(chain.from_iterable(parts)) - {""})
        self._add(known, unknown, self.encode(unknown))
        known[""] = b""
        return [known[c] + known[m] for c, m in parts]

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        split = [words_of(t) for t in texts]
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        # The words of these texts in a table of their own, as looking up in a large one takes longer.
        found, new = self._known(set().union(*split))
        self._add(found, new, self._new(new))
        return [b"".join(map(found.__getitem__, words)) for words in split]
