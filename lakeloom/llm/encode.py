"""Token ids of whole texts, equal to those of the tokenizers library.

Byte-level vocabularies are merged by tiktoken, which reads the file's own merges and keeps nothing between texts. With
vocabularies that drop white space, each distinct white-space piece is encoded once a worker. All else goes to the
tokenizers library itself."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

from lakeloom.llm.runtime import worker_state

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Places in which a piece that was met leaves a mark.
MET = 1 << 23

#: Pieces, and words of them, that a worker of a PieceEncoder keeps at most.
REMEMBERED = 600_000

#: Characters that not every library holds to be white space, or that are white space below PLAIN.
_ODD_SPACE = re.compile(r"[\x09\x0b-\x0d\x1c-\x1f\x85\xa0]")

#: How the two kinds of vocabulary divide a piece before merging, as their files state.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DROPPED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Signs that end words, each of which is a piece of its own after letters.
ENDINGS = frozenset(".,;:!?")

#: Below this code point, case and classes are the same in every library.
PLAIN = "ɐ"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: a printable Latin-1 character stands for
    itself, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeEncoder:
    """encode(text) for a byte-level vocabulary file, by tiktoken, with the ids that the tokenizers library gives. reads()
    lets only files pass for which that holds: no normalizer; the byte-level pre-tokenizer with its own pattern, no space
    put in front; plain BPE whose ids rank its merges, with all bytes among its tokens and nothing beside them. Both
    libraries then divide a text by one pattern, whose three classes (letters, numbers, white space) are told apart alike
    for every code point, which the tests go through one by one; and within a piece both merge the pair that ranks
    first, the leftmost of equals, until none is left, so the ids are the same. Two kinds of texts go to the tokenizers library: those with one
    of the file's added tokens, and those that tiktoken's pattern can't read for a white-space run of millions."""

    def __init__(self, path: str, said: dict):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(x["content"]) for x in said["added_tokens"]) or r"(?!)").search
        values = {letter: b for b, letter in byte_letters().items()}
        special = {x["content"] for x in said["added_tokens"]}
        ranks = {bytes(map(values.__getitem__, k)): v for k, v in said["model"]["vocab"].items() if k not in special}
        self.core = tiktoken.Encoding("own", pat_str=SPACED, mergeable_ranks=ranks, special_tokens={})._core_bpe

    @staticmethod
    def reads(said: dict) -> bool:
        """Whether a vocabulary file's settings are those that tiktoken has too, and its ids rank its merges."""
        before, model, vocab = said["pre_tokenizer"] or {}, said["model"], said["model"].get("vocab")
        plain = not said["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        letters = set(byte_letters().values())
        special = {x["content"] for x in said["added_tokens"]}
        return made == sorted(set(made)) and letters <= vocab.keys() and len(vocab.keys() - special) == len(letters) + len(made)

    def encode(self, text: str) -> bytes:
        if not self.added(text):
            try:
                return bytes(self.core.encode_to_tiktoken_buffer(text, set()))
            except ValueError:  # the pattern's stack
                pass
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()


class _Pieces(dict):
    """Ids by piece, found when asked for, and remembered from the second time on: most pieces that a text has for the first
    time are not met again. Beyond so many the memory starts anew."""

    def __init__(self, find, remembered: int):
        self.find, self.remembered, self.met = find, remembered, bytearray(MET)

    def __missing__(self, piece: str) -> bytes:
        ids, place = self.find(piece), hash(piece) % MET
        if self.met[place]:
            if len(self) >= self.remembered:
                self.clear()
                self.met = bytearray(MET)
            self[piece] = ids
        else:
            self.met[place] = 1
        return ids


class PieceEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers, equal to what the library gives for the
    whole text.

    Where the vocabulary drops white space, tokens never span it, so a text is cut there. A new piece of plain
    characters is divided by the file's pattern and merged by the library's model; any other new piece takes the
    library's whole way. With a vocabulary that keeps white space, each whole text does."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced = self.library.encode(" ", add_special_tokens=False).ids != []
        self.known, self.words = _Pieces(self._piece, remembered), _Pieces(self._tokens, remembered)
        self.divide = regex.compile(DROPPED).findall
        self.letters = byte_letters()

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _tokens(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            if max(piece) >= PLAIN:
                return self._whole(piece)
            piece = unicodedata.normalize("NFC", piece)
        low = piece.lower()
        if low.isalpha():  # one word
            return self.words[low] if low in self.words else self._tokens(low)
        if low[:-1].isalpha() and low[-1] in ENDINGS:
            return self.words[low[:-1]] + self.words[low[-1]]
        if not piece or "<" in piece or _ODD_SPACE.search(piece):
            return self._whole(piece)
        return b"".join(map(self.words.__getitem__, self.divide(low)))

    def encode(self, text: str) -> bytes:
        if self.spaced:
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


def make_encoder(path: str, remembered: int = REMEMBERED) -> MergeEncoder | PieceEncoder:
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    return MergeEncoder(path, said) if MergeEncoder.reads(said) else PieceEncoder(path, remembered)


def encoder(path: str) -> MergeEncoder | PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    return worker_state(("encoder", path), lambda: make_encoder(path))
