"""A byte-level BPE tokenizer compiled to deterministic transducers that count its tokens.

The pre-tokenizer becomes a transducer over character classes whose transitions mark where pieces begin. Texts are
cut into chunks; every chunk's map from entry state to exit state is run in step with the others, and the maps
compose through a parallel prefix scan, which gives each chunk its entry state.

Within a piece, merges become a transducer over bytes. The last token of each prefix settles the token of the next,
so a state holds, for each suffix that begins a token, the token before it and how many tokens lie between; a
transition is annotated with the change of the count. States are determinised when first met.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
from tokenizers import Regex, normalizers

#: Character classes: letters that end a contraction have their own.
LETTER, STMD, R, V, LL, E, NUMBER, APOSTROPHE, SPACE, BLANK, OTHER, RESET = range(12)
#: States: what the piece under way is. AR, AV and AL have read 'r, 'v and 'l.
BEGIN, WORD, DIGITS, MARKS, APO, AR, AV, AL, DONE, SPACES, BLANKS = range(11)
_LETTERS = (LETTER, STMD, R, V, LL, E)
_CHUNK = 256
#: Stand for the end of a text and, after it, for each special token; no valid text holds a surrogate.
_END = 0xD800


def transition(state: int, kind: int) -> tuple[int, bool, bool]:
    """(next state, whether a piece begins here, whether one begins a character before)."""
    late = state in (AR, AV, AL)
    if kind == RESET:
        return BEGIN, True, late
    if kind in (SPACE, BLANK):
        return (SPACES if kind == SPACE else BLANKS), state not in (SPACES, BLANKS), late
    before = state in (SPACES, BLANKS)  # the last white space leaves its run
    joins = state == SPACES
    if kind in _LETTERS:
        if state == APO:
            if kind == STMD:
                return DONE, False, False
            if kind in (R, V, LL):
                return {R: AR, V: AV, LL: AL}[kind], False, False
            return WORD, True, False
        if (state in (AR, AV) and kind == E) or (state == AL and kind == LL):
            return DONE, False, False
        return WORD, not (state == WORD or late or joins), late or before
    if kind == NUMBER:
        return DIGITS, not (state == DIGITS or joins), late or before
    follows = state in (MARKS, APO)
    if kind == APOSTROPHE and not (follows or joins):
        return APO, True, late or before
    return MARKS, not (follows or joins), late or before


def _tables() -> tuple[bytes, bytes]:
    """By 16 * state + class: 16 * next state; 1 for a piece that begins here plus 2 for one that began before."""
    go, out = bytearray(256), bytearray(256)
    for s in range(11):
        for c in range(12):
            to, here, before = transition(s, c)
            go[16 * s + c], out[16 * s + c] = 16 * to, here + 2 * before
    return bytes(go), bytes(out)


_GO, _OUT = _tables()


def class_table() -> bytes:
    """The class of every code point, as the tokenizers library's own expressions see it."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    at = np.array(points)
    for pattern, kind in ((r"\s", BLANK), (r"\p{N}", NUMBER), (r"\p{L}", LETTER)):
        mark = "\x00" if kind != OTHER else "\x01"
        seen = normalizers.Replace(Regex(pattern), mark).normalize_str(every)
        hit = np.frombuffer(seen.encode("utf-32-le"), np.uint32) == 0
        hit[0] = False  # NUL itself is none of them
        table[at[hit]] = kind
    for chars, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", LL), ("e", E), ("'", APOSTROPHE), (" ", SPACE)):
        table[[ord(c) for c in chars]] = kind
    table[0xD800:0xE000] = RESET
    return table.tobytes()


def _run(columns: np.ndarray, state: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Step all lanes through their columns at once; fills ``out`` with what the transitions emit."""
    for j, kinds in enumerate(columns):
        at = (state + kinds).tobytes()
        if out is not None:
            out[j] = np.frombuffer(at.translate(_OUT), np.uint8).reshape(state.shape)
        state = np.frombuffer(at.translate(_GO), np.uint8).reshape(state.shape)
    return state


def entry_states(maps: np.ndarray) -> np.ndarray:
    """Each chunk's entry state when the first enters at BEGIN. maps[i, s]: chunk i's exit state from s.

    An inclusive scan by doubling: after step d, row i is the composition of up to 2d chunks that end with it.
    """
    scan, d = maps.astype(np.intp), 1
    while d < len(scan):
        scan[d:] = np.take_along_axis(scan[d:], scan[:-d].copy(), axis=1)
        d *= 2
    return np.concatenate([[BEGIN], scan[:-1, BEGIN]]).astype(np.uint8)


def piece_starts(kinds: np.ndarray, chunk: int = _CHUNK) -> np.ndarray:
    """Positions where pieces begin; ``kinds`` are the characters' classes and end with RESET."""
    n = len(kinds)
    lanes = -(-n // chunk)
    padded = np.full(lanes * chunk, RESET, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    every = np.repeat(16 * np.arange(11, dtype=np.uint8)[:, None], lanes, axis=1)
    maps = _run(columns[:, None, :], every).T // 16
    marks = np.empty((chunk, lanes), np.uint8)
    _run(columns, 16 * entry_states(maps), marks)
    marks = marks.T.reshape(-1)[:n]
    starts = (marks & 1).astype(bool)
    starts[:-1] |= marks[1:] > 1
    return np.flatnonzero(starts)


def _bytes_of_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the
    others follow in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _State(dict):
    """By byte: (next state, change of the count). content: what the state stands for."""

    __slots__ = ("content",)


_NEVER = 1 << 30


class MergeTransducer:
    """Counts the tokens of a piece's bytes. ``limit``: so many states at most are kept; then they are met anew."""

    def __init__(self, merges: list, limit: int = 150_000) -> None:
        letters = _bytes_of_letters()
        raw = lambda x: bytes(letters[c] for c in x)
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in merges]
        self.ranks = {p: i for i, p in reversed([*enumerate(pairs)])}
        #: Of each merged token, its parts and rank.
        self.parts = {a + b: (a, b, i) for i, (a, b) in enumerate(pairs)}
        made = lambda t: self.parts[t][2] if len(t) > 1 else -1
        #: Whether every token has one derivation, whose parts were merged before it.
        self.plain = len(self.parts) == len(pairs) and all(len(x) == 1 or x in self.parts and made(x) < i for i, p in enumerate(pairs) for x in p)
        self.children: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for t in [bytes([b]) for b in range(256)] + list(self.parts):
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = self.children[node][b]
            self.token[node] = t
        self.limit = limit
        self.pairs: dict[tuple, bool] = {}
        self.edges: dict[tuple, tuple] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((0, None, 0),))

    def _state(self, content: tuple) -> _State:
        state = self.states.get(content)
        if state is None:
            self.states[content] = state = _State()
            state.content = content
        return state

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE: the leftmost pair of the lowest rank is merged until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, _NEVER), i) for i, p in enumerate(zip(parts, islice(parts, 1, None), strict=False)))
            if rank == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> tuple:
        """From the byte at a token's left (0) or right (1) edge up to the token: each part there, with the rank of
        the merge that takes it up."""
        key = (token, side)
        if key not in self.edges:
            steps, taken = [(token, _NEVER)], token
            while len(taken) > 1:
                *both, rank = self.parts[taken]
                taken = both[side]
                steps.append((taken, rank))
            self.edges[key] = tuple(reversed(steps))
        return self.edges[key]

    def _fits(self, before: bytes | None, token: bytes) -> bool:
        """Whether ``token`` can follow: the two, merged from their bytes, come out as they are.

        Where parts are merged before what they make, it is enough to follow the parts that meet between the two:
        none of their pairs may have a rank below that of the merge which takes one of them up (on the left, an
        equal one comes first).
        """
        key = (before, token)
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > 4 * self.limit:
            self.pairs.clear()
        if before is None or not self.plain:
            known = self.merge((before or b"") + token) == ([token] if before is None else [before, token])
        elif not self._fits(None, token):
            known = False
        else:
            known, left, right, i, j, ranks = True, self._edge(before, 1), self._edge(token, 0), 0, 0, self.ranks
            while True:
                (a, up), (b, over) = left[i], right[j]
                rank = ranks.get((a, b), _NEVER)
                if rank < up and rank <= over and rank != _NEVER:
                    known = False
                    break
                if up == over == _NEVER:
                    break
                if up <= over:
                    i += 1
                else:
                    j += 1
        self.pairs[key] = known
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, int]:
        children, tokens = self.children, self.token
        token, change, longer = None, 0, []
        for node, before, since in state.content:
            to = children[node].get(byte)
            if to is None:
                continue
            if token is None:
                t = tokens[to]
                if t is not None and self._fits(before, t):
                    token, change = t, 1 - since
            if children[to]:
                longer.append((to, before, since))
        content = tuple([(n, b, s + change) for n, b, s in longer] if change else longer) + ((0, token, 0),)
        state[byte] = out = (self._state(content), change)
        return out

    def count(self, word: bytes) -> int:
        if len(self.states) > self.limit:
            self._forget()
        state, total = self.start, 0
        for byte in word:
            step = state.get(byte)
            if step is None:
                step = self._step(state, byte)
            state = step[0]
            total += step[1]
        return total


class _Pieces(dict):
    """Counts by piece, for up to ``limit`` pieces at a time."""

    def __init__(self, merges: MergeTransducer, fixed: dict[str, int], limit: int = 400_000) -> None:
        self.merges, self.fixed, self.limit = merges, fixed, limit
        self.update(fixed)

    def __missing__(self, piece: str) -> int:
        if len(self) > self.limit:
            self.clear()
            self.update(self.fixed)
        n = self.merges.count(piece.encode())
        if len(piece) < 64:
            self[piece] = n
        return n


class TokenCounter:
    """``spec``: a tokenizer file's content; ``classes``: what :func:`class_table` returns."""

    def __init__(self, spec: bytes, classes: bytes, chunk: int = _CHUNK) -> None:
        s = json.loads(spec)
        model, pre = s["model"], s["pre_tokenizer"]
        plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and s.get("normalizer") is None
        if not plain or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("only a plain byte-level BPE without normalizer and prefix space is compiled")
        added = [t["content"] for t in s["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in s["added_tokens"]) or len(added) > 1:
            raise ValueError("only one added token, without options, is compiled")
        self.special = {t: chr(_END + 1 + i) for i, t in enumerate(added)}
        self.classes, self.chunk = np.frombuffer(classes, np.uint8), chunk
        self.pieces = _Pieces(MergeTransducer(model["merges"]), {chr(_END): 0} | {c: 1 for c in self.special.values()})

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        parts = []
        for t in texts:
            for token, mark in self.special.items():
                if token in t:
                    t = t.replace(token, mark)
            parts.append(t)
        end = chr(_END)
        whole = end.join(parts) + end
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = piece_starts(self.classes[points], self.chunk)
        bounds = [*starts.tolist(), len(whole)]
        pieces = self.pieces
        counts = np.fromiter((pieces[whole[a:b]] for a, b in zip(bounds, islice(bounds, 1, None), strict=False)), np.int64, len(starts))
        ends = np.flatnonzero(points == _END)
        total = np.cumsum(counts)[np.searchsorted(starts, ends)]
        return np.diff(total, prepend=0)
