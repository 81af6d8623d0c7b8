"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers run over a text. The first, over classes of characters, divides it into the words within
which merging happens; its transitions say where a word begins. It is run in parallel: each chunk of characters is
mapped to a state map (end state for every start state), the maps are composed by a prefix scan, and each chunk then
runs from its true start state. The second, over bytes, counts tokens: its transitions carry the tokens that a byte
adds (it may take some back, when they merge). Its states are found as texts need them and kept. A long word is cut
into chunks, which all step together: the bytes before a chunk lead to the state that it starts from, so each chunk
maps that state to the one at its end. These maps are composed along the word; where the chunk before ends in another
state than the one led to, the chunk is mapped anew from it.

A state of the second holds, for each place where a token that ends later may have begun: the vocabulary-trie node
reached from there, the last token before it, and the tokens up to it less those up to here. A token may follow
another exactly if merging their joined bytes gives these two again. There is always one such token, so the next state
is determined; the trie is finite, and so is the set of states.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from lakeloom.llm.encode import byte_letters
from lakeloom.llm.runtime import record, small_batches, texts, tidy, worker_state

ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

#: Classes of characters that the word pattern tells apart. STMD, R, V, L and E are the letters of
#: 's 't 'm 'd 're 've 'll.
LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, STMD, R, V, L, E, RESET = range(12)
CLASSES = 12
#: States of the dividing transducer. After a run of white space, what was read last is a space or not, alone or not;
#: after a quote that begins a word, up to one letter of a contraction.
START, WORD, DIGITS, SIGNS, SPACE1, SPACES, WHITE1, WHITES, QUOTED, QR, QV, QL, CONTRACTED = range(13)
STATES = 13
CUT, CUT_BEFORE = 1, 2
CHUNK = 256
#: Characters of texts that are worked on together.
BATCH_CHARS = 1 << 20
#: States and pairs of tokens kept by a worker; beyond this many they are found anew.
KEPT_STATES, KEPT_PAIRS = 600_000, 2_000_000
#: Bytes of words that step together, each of which may bring a new state.
STEP_BYTES = 1 << 18
#: Bytes of a word beyond which it is cut; of its chunks; of the run that leads to a chunk; and chunks that step together.
LONG, LONG_CHUNK, LEAD, LANES = 1024, 512, 96, 4096


def dividing_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, flags) by state * CLASSES + class. CUT: a word begins at this character; CUT_BEFORE: one begins at
    the character before it."""
    letters = {LETTER, STMD, R, V, L, E}
    step, flag = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    plain = {c: WORD for c in letters} | {NUMBER: DIGITS, QUOTE: SIGNS, OTHER: SIGNS}
    begin = plain | {QUOTE: QUOTED, SPACE: SPACE1, WHITE: WHITE1}
    for s in range(STATES):
        for c in range(CLASSES):
            if c == RESET:
                step[s, c], flag[s, c] = START, CUT_BEFORE * (s in (QR, QV, QL))
                continue
            to, f = begin[c], CUT
            if s in (WORD, QR, QV, QL):
                to, f = (WORD, 0) if c in letters else (to, f)
                if s != WORD:
                    to, f = (CONTRACTED, 0) if c == (L if s == QL else E) else (to, f | CUT_BEFORE)
            elif s == DIGITS and c == NUMBER or s in (SIGNS, QUOTED) and c in (QUOTE, OTHER):
                to, f = plain[c], 0
            elif s == QUOTED and c in (STMD, R, V, L):
                to, f = {STMD: CONTRACTED, R: QR, V: QV, L: QL}[c], 0
            elif s in (SPACE1, SPACES, WHITE1, WHITES):
                if c in (SPACE, WHITE):
                    to, f = (SPACES if c == SPACE else WHITES), 0
                else:
                    to = plain[c] if s in (SPACE1, SPACES) else to
                    f = CUT_BEFORE * (s in (SPACES, WHITES)) | CUT * (s in (WHITE1, WHITES))
            step[s, c], flag[s, c] = to, f
    return step.reshape(-1), flag.reshape(-1)


def character_classes() -> np.ndarray:
    """Class by code point; the last entry is the mark that ends a text. The libraries at hand know different versions of
    Unicode: where two of them disagree on a code point, the tokenizers library's own division decides."""
    out = np.full(0x110001, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, everything):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = c
    out[0xD800:0xE000] = out[0x1C:0x20] = OTHER  # the library's white space is Unicode's
    pieces = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in everything:
        if out[ord(c)] != {"L": LETTER, "N": NUMBER, "Z": WHITE}.get(category(c)[0], OTHER) and ord(c) > 0xFF:
            alike = (k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(pieces(x + c)) == 1)
            out[ord(c)] = next(alike, WHITE)
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(x) for x in chars]] = c
    out[0x110000] = RESET
    return out


def run_divider(classes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The state before each character, from START, by chunk state maps and their prefix scan."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, RESET, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = step[maps.astype(np.int16) * CLASSES + row[:, None]]
    scanned, d = maps, 1
    while d < chunks:  # the map of chunks up to each one, composed in log steps
        joined = scanned.copy()
        joined[d:] = np.take_along_axis(scanned[d:], scanned[:-d].astype(np.intp), axis=1)
        scanned, d = joined, 2 * d
    state = np.concatenate([[START], scanned[:-1, START]]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), np.uint8)
    for k, row in enumerate(grid):
        out[k] = state
        state = step[state.astype(np.int16) * CLASSES + row]
    return out.T.reshape(-1)[:n]


class CountingTransducer:
    """Tokens of words, for a byte-level BPE vocabulary whose ids follow the order of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        letters = {v: k for k, v in byte_letters().items()}
        vocabulary = {bytes(letters[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.special = sorted(special, key=len, reverse=True)
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        nodes = 1
        for token, i in vocabulary.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                node = self.trie[key]
            self.token_at[node] = i
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for m in model["model"]["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair, i = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            self.merged[pair] = i
            self.halves.setdefault(i, pair)
        self.follows: dict[tuple[int, int], bool] = {}
        self.trie_keys = np.array(sorted(self.trie), np.int64)
        self.trie_to = np.array([self.trie[k] for k in self.trie_keys.tolist()], np.int64)
        self.token_of = np.full(nodes, -1, np.int64)
        self.token_of[list(self.token_at)] = list(self.token_at.values())
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.walked: dict[int, tuple[int, int]] = {}
        size = 1 << 22
        self.shift = np.uint64(64 - 22)
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.adds = np.zeros(size, np.int8)
        self.filled = 0
        self._state(((0, -1, 0),))

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b gives a and b: no pair at their border merges before both
        are whole. The border is opened from the later merge on, down to the earlier ones."""
        known = self.follows.get((a, b))
        if known is None:
            left, right, limit, known = a, b, 1 << 60, True
            while True:
                if self.merged.get((left, right), limit) < limit:
                    known = False
                    break
                l_split, r_split = self.halves.get(left), self.halves.get(right)
                if l_split is None and r_split is None:
                    break
                if r_split is None or l_split is not None and left > right:
                    limit, left = left, l_split[1]
                else:
                    limit, right = right + 1, r_split[0]
            self.follows[a, b] = known
        return known

    def _state(self, state: tuple) -> int:
        i = self.ids.get(state)
        if i is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
        return i

    def _transition(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens added)."""
        alive, found = [], None
        for node, last, count in self.states[state]:
            node = self.trie.get(node << 8 | byte)
            if node is not None:
                alive.append((node, last, count))
                token = self.token_at.get(node)
                if token is not None and found is None and (last < 0 or self.may_follow(last, token)):
                    found = token, count + 1
        token, added = found
        return self._state((*((node, last, count - added) for node, last, count in alive), (0, token, 0))), added

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table of transitions, or the empty place where it should."""
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        wrong = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            wrong = wrong[(self.keys[at[wrong]] != keys[wrong]) & (self.keys[at[wrong]] != -1)]
        return at

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]."""
        lengths = ends - starts
        out = np.empty(len(starts), np.int64)
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._long(data[starts[i] : ends[i]])
        short = np.flatnonzero(lengths <= LONG)
        for part in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // STEP_BYTES)) + 1):
            out[part] = self._short(data, starts[part], lengths[part])
        return out

    def _bound(self) -> None:
        if len(self.follows) > KEPT_PAIRS:
            self.follows.clear()
        if self.filled > len(self.keys) // 2 or len(self.states) > KEPT_STATES or len(self.walked) > KEPT_STATES:
            self._forget()

    def _short(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word, all words stepping together."""
        self._bound()
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        for k, m in enumerate(alive.tolist()):
            keys = state[:m] << 8 | data[starts[:m] + k]
            at = self._slots(keys)
            if (missing := self.keys[at] == -1).any():
                for key in np.unique(keys[missing]).tolist():
                    to, added = self._transition(key >> 8, key & 255)
                    slot = self._slots(np.array([key]))[0]
                    self.keys[slot], self.next[slot], self.adds[slot] = key, to, added
                    self.filled += 1
                at = self._slots(keys)
            state[:m] = self.next[at]
            total[:m] += self.adds[at]
        out = np.empty(len(total), np.int64)
        out[order] = total
        return out

    def _lanes(self, data: np.ndarray, cuts: np.ndarray) -> list[tuple[tuple, tuple, int]]:
        """For each chunk data[cut:next cut]: the state led to by the bytes before it, the state at its end, and the
        tokens it adds from the one to the other. Chunks step together, and no state is kept.

        What is alive is a flat list, older beginnings first: chunk, trie node, last token before, tokens up to it."""
        first = np.maximum(cuts[:-1] - LEAD, 0)
        lead, n = cuts[:-1] - first, len(first)
        length, begun = cuts[1:] - first, np.zeros(n, np.int64)
        lane, node, last, count = np.arange(n), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        led: list[tuple] = [()] * n
        ended: list[tuple] = [()] * n

        def keep(which: np.ndarray, into: list[tuple], total: np.ndarray) -> None:
            at = np.flatnonzero(which[lane])
            at = at[np.argsort(lane[at], kind="stable")]
            rows = zip(lane[at].tolist(), node[at].tolist(), last[at].tolist(), (count[at] - total[lane[at]]).tolist(), strict=True)
            for i, *entry in rows:
                into[i] += (tuple(entry),)

        total = np.zeros(n, np.int64)
        keep(lead == 0, led, total)
        for k in range(int(length.max())):
            on = k < length
            alive = on[lane]
            lane, node, last, count = lane[alive], node[alive], last[alive], count[alive]
            keys = node << 8 | data[first[lane] + k]
            at = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
            alive = self.trie_keys[at] == keys
            lane, node, last, count = lane[alive], self.trie_to[at[alive]], last[alive], count[alive]
            token = self.token_of[node]
            ends = np.flatnonzero(token >= 0)
            pairs, which = np.unique(last[ends] << 32 | token[ends], return_inverse=True)
            ok = np.array([p < 0 or self.may_follow(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()], bool)
            ends = ends[ok[which]]
            oldest = np.full(n, -1)
            oldest[lane[ends[::-1]]] = ends[::-1]
            here = np.flatnonzero(on)
            at = oldest[here]
            total[here] = count[at] + 1
            lane, node, last, count = (np.concatenate(x) for x in ((lane, here), (node, np.zeros(len(here), np.int64)), (last, token[at]), (count, total[here])))
            if (now := on & (k + 1 == lead)).any():
                begun[now] = total[now]
                keep(now, led, total)
            if (now := on & (k + 1 == length)).any():
                keep(now, ended, total)
        return list(zip(led, ended, (total - begun).tolist(), strict=True))

    def _walk(self, state: tuple, chunk: bytes) -> tuple[tuple, int]:
        """The state at the end of a chunk, from the one at its beginning, and the tokens added."""
        self._bound()
        at, total = self._state(state), 0
        for b in chunk:
            key = at << 8 | b
            step = self.walked.get(key)
            if step is None:
                step = self.walked[key] = self._transition(at, b)
            at = step[0]
            total += step[1]
        return self.states[at], total

    def _long(self, data: np.ndarray) -> int:
        """Tokens of a long word, by the maps of its chunks."""
        cuts = np.append(np.arange(0, len(data), LONG_CHUNK), len(data))
        state, total = ((0, -1, 0),), 0
        for k in range(0, len(cuts) - 1, LANES):
            part = cuts[k : k + LANES + 1]
            if len(self.follows) > KEPT_PAIRS:
                self.follows.clear()
            for j, (led, ended, added) in enumerate(self._lanes(data, part)):
                if led != state:
                    ended, added = self._walk(state, data[part[j] : part[j + 1]].astype(np.uint8).tobytes())
                state, total = ended, total + added
        return total


class TokenCounter:
    def __init__(self, path: str):
        self.step, self.flag = dividing_transducer()
        self.classes = character_classes()
        self.machine = CountingTransducer(path)
        self.split = regex.compile("|".join(map(regex.escape, self.machine.special))).split if self.machine.special else lambda x: [x]

    def count(self, batch: list[str]) -> np.ndarray:
        """Tokens of each text; a special token's string is one token, as the library has it."""
        parts = [self.split(t) for t in batch]
        pieces = [p for x in parts for p in x]
        owner = np.repeat(np.arange(len(batch)), [len(x) for x in parts])
        total = np.array([len(x) - 1 for x in parts], np.int64)
        sizes = np.array([len(p) + 1 for p in pieces])
        points = np.frombuffer("\0".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        marks = np.cumsum(sizes) - 1
        points[marks] = 0x110000
        classes = self.classes[points]
        before = run_divider(classes, self.step)
        flags = self.flag[before.astype(np.int16) * CLASSES + classes]
        cuts = (flags & CUT) > 0
        cuts[:-1] |= (flags[1:] & CUT_BEFORE) > 0
        cuts[marks] = True
        at = np.flatnonzero(cuts)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        width[marks] = 0
        place = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer("".join(pieces).encode("utf-8"), np.uint8).astype(np.int64)
        starts, ends = place[at], np.append(place[at[1:]], place[-1])
        real = np.flatnonzero(classes[at] != RESET)
        counted = self.machine.counts(data, starts[real], ends[real])
        text = owner[np.searchsorted(marks, at[real], side="left")]
        return total + np.bincount(text, weights=counted, minlength=len(batch)).astype(np.int64)


def counter(path: str) -> TokenCounter:
    """The worker's counter for a vocabulary file."""
    return worker_state(("counter", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """Per document of docs (doc_id, text; null: empty): doc_id, n_bytes, n_tokens, over_limit.

    One pass without a shuffle; a very long text is worked on as one piece of up to its own length, and so is a very
    long word, in time that grows with its length and with a bounded number of states kept. Rows are independent:
    repeats and null ids stay as they are, an empty table gives no rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(vocabulary)
        for batch in batches:
            rows, first, held, counted = texts(batch), 0, 0, []
            for k, t in enumerate(rows):
                held += len(t)
                if held >= BATCH_CHARS or k + 1 == len(rows):
                    counted.append(machine.count(rows[first : k + 1]))
                    first, held = k + 1, 0
            n = np.concatenate(counted) if counted else np.zeros(0, np.int64)
            yield record(ROWS, doc_id=batch.column("doc_id"), n_bytes=[len(t.encode()) for t in rows], n_tokens=n, over_limit=n > limit)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
