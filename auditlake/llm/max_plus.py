"""Tokenisation as a max-plus path problem, cut into chunks.

Nodes are the pieces that match the text; two pieces may follow each other where one ends and
the other begins, if the model allows the pair.  The best path is the tokenisation:

* unigram models: a piece weighs its score, every pair is allowed;
* BPE models: pieces weigh nothing, and a pair is allowed if merging its characters by rank
  gives the pair again.  A sequence whose neighbours are all allowed is the BPE encoding; as all
  paths weigh the same, the first path found is the best one.

A state at a boundary is the piece that reaches it or straddles it.  A chunk is a matrix of best
scores from the states at its begin to those at its end; matrices combine associatively.  Where
a chunk holds a place that every path must cut (a space mark after another character), the matrix
is an outer sum: what lies between two such places (a word, with the marks before it) has a single
state at either end, a 1 x 1 matrix and one best path, which is found once for each distinct word.

The public library reads the model file; it neither encodes nor decodes here.
"""

from __future__ import annotations

import re

import numpy as np

MARK = "▁"
NEVER = -np.inf
State = tuple[int, int]  # begin and end, counted from the boundary
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
HELD = 1 << 19  # distinct words, or pairs of pieces, that a worker remembers
_LONG = 64  # longer words are not remembered


class Pieces:
    """The pieces of a SentencePiece model and its rules."""

    def __init__(self, proto: bytes, held: int = HELD):
        import sentencepiece

        self.held = held
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        lib, n = self.lib, self.lib.get_piece_size()
        self.ids = {lib.id_to_piece(i): i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        self.scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.fallback = lib.is_byte(self.bytes[0])
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character; texts of this model cannot be cut at spaces")
        # ranks of a BPE model are whole numbers that fall by one
        values = sorted(self.scores.values(), reverse=True)
        self.bpe = all(v == int(v) for v in values[:1000])
        # how each piece is merged from two; only for pieces that merging gives
        self._halves: dict[str, tuple[str, str] | None] = {}
        if self.bpe:
            self._halves = {p: h for p in self.ids if (h := self._last_merge(p)) is not None or len(p) == 1}
        # what pieces begin with, and how long the longest piece is that it begins with
        self._begun: dict[str, int] = {}
        for p in self._halves:
            length = 1
            for k in range(2, len(p) + 1):
                length = k if p[:k] in self._halves else length
                self._begun[p[:k]] = length
        # two neighbouring characters that no piece holds: every path cuts between them, and no merge crosses the cut
        self._joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self.least = min(self.scores.values()) - 10
        # what each id decodes to; bytes are put together
        self.shown = [self._text(i) for i in range(n)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if self.fallback else {}
        probe = " Ａﬁ①  é e\u0301\t\n ½ "
        if lib.decode(lib.encode(probe)) != probe or lib.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("the model changes texts before it splits them, or puts no mark in front; only models that do neither are supported")

    def _text(self, i: int) -> str:
        return "" if self.lib.is_control(i) else " \u2047 " if self.lib.is_unknown(i) else self.lib.id_to_piece(i).replace(MARK, " ")

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merge last; null where merging does not give the piece."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1], NEVER)
                if score > best:
                    best, at = score, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def stands(self, piece: str) -> bool:
        return not self.bpe or len(piece) == 1 or piece in self._halves

    def allowed(self, one: str, two: str) -> bool:
        if not self.bpe or (one[-1] != MARK and two[0] == MARK):
            return True
        key = one, two
        if key not in self._pairs:
            if len(self._pairs) >= self.held:
                self._pairs.clear()
            self._pairs[key] = self._apart(one, two)
        return self._pairs[key]

    def _apart(self, one: str, two: str) -> bool:
        """Whether no merge crosses the border of two pieces: merges are undone from the last to the first, and at no time
        may what stands at the border make a piece that would merge sooner than the next merge undone."""
        scores, halves = self.scores, self._halves
        next_left, next_right = NEVER, NEVER  # scores of the merge undone last, on either side
        while True:
            across = scores.get(one + two, NEVER)
            # of equal merges the left one comes first
            if across > NEVER and across > next_left and across >= next_right:
                return False
            left = scores[one] if halves.get(one) else None
            right = scores[two] if halves.get(two) else None
            if left is None and right is None:
                return True
            # the merge with the lower score came later
            if right is None or (left is not None and left < right):
                one, next_left, next_right = halves[one][1], left, NEVER
            else:
                two, next_left, next_right = halves[two][0], NEVER, right

    def weight(self, piece: str) -> float:
        return 0.0 if self.bpe else self.scores.get(piece, self.least)

    def starting(self, text: str, at: int) -> list[int]:
        """Ends of the pieces that begin at ``at``; a character that no piece is stands alone."""
        if self.bpe:
            ends = [at + 1]
            for j in range(at + 2, len(text) + 1):
                length = self._begun.get(text[at:j])
                if length is None:
                    break
                if length == j - at:
                    ends.append(j)
            return ends
        ends = [b for b in range(at + 1, min(len(text), at + self.longest) + 1) if text[at:b] in self.ids and self.stands(text[at:b])]
        return ends if ends and ends[0] == at + 1 else [at + 1, *ends]

    def numbers(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def best(self, word: str) -> list[int]:
        """Ids of the best path over what lies between two forced cuts."""
        if not self.bpe:
            return self._heaviest(word)
        joined, known = self._joined, self._words
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in joined]
        if not cuts:
            return self._first(word)
        out: list[int] = []
        begin = 0
        for end in (*cuts, len(word)):
            part = word[begin:end]
            ids = known.get(part)
            if ids is None:
                ids = self._first(part)
                self._remember(part, ids)
            out += ids
            begin = end
        return out

    def _remember(self, word: str, ids: list[int]) -> None:
        if len(word) <= _LONG:
            if len(self._words) >= self.held:
                self._words.clear()
            self._words[word] = tuple(ids)  # which the collector of cycles need not look at

    def _first(self, word: str) -> list[int]:
        """The first path, longest pieces first; a piece from which no path goes on is left for good."""
        size, begun, pairs, ids = len(word), self._begun, self._pairs, self.ids
        path: list[tuple[int, int]] = []
        dead: set[tuple[int, int]] = set()
        at, j, before = 0, -1, ""  # the end to try next; below 0 the farthest
        while at < size:
            if j < 0:
                j = at + 1
                for k in range(at + 2, size + 1):
                    length = begun.get(word[at:k])
                    if length is None:
                        break
                    j = at + length
            while j > at:
                piece = word[at:j]
                fits = not before or pairs.get((before, piece))
                if fits is None:
                    fits = self.allowed(before, piece)
                if fits and (not dead or (at, j) not in dead):
                    path.append((at, j))
                    at, j, before = j, -1, piece
                    break
                j = at + begun[word[at : j - 1]] if j - at > 2 else j - 1
            else:
                dead.add(path[-1])
                at, j = path.pop()
                before = word[path[-1][0] : at] if path else ""
                j = at + begun[word[at : j - 1]] if j - at > 2 else j - 1
        out: list[int] = []
        for a, b in path:
            n = ids.get(word[a:b])
            if n is None:
                out += self.numbers(word[a:b])
            else:
                out.append(n)
        return out

    def _heaviest(self, word: str) -> list[int]:
        # {piece end: {piece begin: (score, begin of the piece before)}}
        ending: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(word) + 1)]
        for i in range(len(word)):
            before = ending[i]
            if i and not before:
                continue
            for j in self.starting(word, i):
                piece = word[i:j]
                if not i:
                    ending[j][0] = self.weight(piece), -1
                    continue
                found = [(score, a) for a, (score, _) in before.items() if self.allowed(word[a:i], piece)]
                if found:
                    score, a = max(found)
                    ending[j][i] = score + self.weight(piece), a
        out, end = [], len(word)
        begin = max(ending[end], key=lambda a: ending[end][a][0])
        while begin >= 0:
            out.append(word[begin:end])
            begin, end = ending[end][begin][1], begin
        return [n for piece in reversed(out) for n in self.numbers(piece)]

    def words(self, body: str) -> list[int]:
        """Ids of a marked text, or of a part that begins and ends at forced cuts."""
        out: list[int] = []
        known = self._words
        for word in _WORD.findall(body):
            ids = known.get(word)
            if ids is None:
                ids = self.best(word)
                self._remember(word, ids)
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        return self.words(marked(text))

    def decode(self, ids: list[int]) -> str:
        """The text of pieces, without the mark in front; bytes that are no UTF-8 are shown as U+FFFD each."""
        if not self.byte_of.keys().isdisjoint(ids):
            parts: list[str] = []
            held = bytearray()
            for i in ids:
                if i in self.byte_of:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    parts.append(_shown(held))
                    held = bytearray()
                parts.append(self.shown[i])
            if held:
                parts.append(_shown(held))
            out = "".join(parts)
        else:
            out = "".join([self.shown[i] for i in ids])
        first = next((i for i in ids if not self.lib.is_control(i)), None)
        return out[1:] if first is not None and first not in self.byte_of and not self.lib.is_unknown(first) and out[:1] == " " else out


def _shown(data: bytearray) -> str:
    """Bytes as UTF-8; each byte of what is none as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(data[at : at + size]).decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


def marked(text: str) -> str:
    """The text as the model sees it: spaces are marks, and one is put in front."""
    return MARK + text.replace(" ", MARK) if text else ""


def states(pieces: Pieces, text: str, at: int) -> list[State]:
    """The pieces that begin before ``at`` and reach it."""
    return [(a - at, b - at) for a in range(max(0, at - pieces.longest), at) for b in pieces.starting(text, a) if b >= at]


class Chunk:
    """text[begin:end), given with ``longest`` characters around it (fewer at the ends of the document)."""

    def __init__(self, pieces: Pieces, text: str, begin: int, end: int, first: bool, last: bool):
        self.pieces, self.text, self.begin, self.end = pieces, text, begin, end
        self.entry: list[State] = [(0, 0)] if first else states(pieces, text, begin)
        self.exit: list[State] = [(0, 0)] if last else states(pieces, text, end)
        self.last = last
        reach = pieces.longest
        cuts = (i for i in range(begin + reach, end - reach + 1) if text[i] == MARK and text[i - 1] != MARK)
        self.one = next(cuts, None)
        self.two = None
        if self.one is not None:
            self.two = next(i for i in range(end - reach, self.one - 1, -1) if text[i] == MARK and text[i - 1] != MARK)

    def _paths(self, begin: int, end: int, starts: list[State]):
        """Best scores from each start to each piece that begins in [begin, end): {piece end: {piece begin: vector}}."""
        size = len(starts)
        ending: dict[int, dict[int, np.ndarray]] = {}
        for k, (a, b) in enumerate(starts):
            vector = np.full(size, NEVER)
            vector[k] = 0.0
            ending.setdefault(begin + b, {})[begin + a] = vector
        for i in range(begin, end):
            before = ending.get(i)
            if not before:
                continue
            for j in self.pieces.starting(self.text, i):
                piece = self.text[i:j]
                got = [v for a, v in before.items() if a == i or self.pieces.allowed(self.text[a:i], piece)]
                if got:
                    best = np.max(got, axis=0) + self.pieces.weight(piece)
                    if np.isfinite(best).any():
                        ending.setdefault(j, {})[i] = best
        return ending

    def _to(self, ending, at: int) -> np.ndarray | None:
        found = ending.get(at)
        return np.max(list(found.values()), axis=0) if found else None

    def matrix(self) -> np.ndarray:
        """Best score from each entry state to each exit state."""
        if self.one is None:
            return self._out(self._paths(self.begin, self.end, self.entry), len(self.entry))
        head = self._to(self._paths(self.begin, self.one, self.entry), self.one)
        tail = self._out(self._paths(self.two, self.end, [(0, 0)]), 1)[0]
        head = np.full(len(self.entry), NEVER) if head is None else head
        return head[:, None] + tail[None, :]

    def _out(self, ending, size: int) -> np.ndarray:
        out = np.full((size, len(self.exit)), NEVER)
        if self.last:
            found = self._to(ending, self.end)
            return out if found is None else found[:, None]
        for k, (a, b) in enumerate(self.exit):
            vector = ending.get(self.end + b, {}).get(self.end + a)
            if vector is not None:
                out[:, k] = vector
        return out

    def _walk(self, begin: int, end: int, starts: list[State], start: int, goal: tuple[int, int] | None) -> list[str]:
        """Pieces that begin in [begin, end) on the best path from one start to the goal (or to whatever ends at ``end``)."""
        ending = self._paths(begin, end, starts)
        if goal is None:
            found = ending[end]
            goal = (max(found, key=lambda a: found[a][start]), end)
        out: list[str] = []
        a, b = goal
        origin = (begin + starts[start][0], begin + starts[start][1])
        while (a, b) != origin:
            piece = self.text[a:b]
            out.append(piece)
            before = {x: v for x, v in ending[a].items() if x == a or self.pieces.allowed(self.text[x:a], piece)}
            a, b = max(before, key=lambda x: before[x][start]), a
        return out[::-1]

    def trace(self, entry: int, exit_: int) -> list[int]:
        """Ids of the pieces that begin in this chunk, between the given states."""
        goal = None if self.last else (self.end + self.exit[exit_][0], self.end + self.exit[exit_][1])
        if self.one is None:
            return [n for p in self._walk(self.begin, self.end, self.entry, entry, goal) for n in self.pieces.numbers(p)]
        head = [n for p in self._walk(self.begin, self.one, self.entry, entry, None) for n in self.pieces.numbers(p)]
        middle = self.pieces.words(self.text[self.one : self.two])
        tail = [n for p in self._walk(self.two, self.end, [(0, 0)], 0, goal) for n in self.pieces.numbers(p)]
        return head + middle + tail


def combine(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Max-plus product of two neighbouring chunks' matrices."""
    return np.max(one[:, :, None] + two[None, :, :], axis=1)


def choose(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of every chunk on the best path, by a scan of prefix products."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(combine(prefix[-1], m))
    out, at = [], int(np.argmax(prefix[-1][0]))
    for k in range(len(matrices) - 1, -1, -1):
        entry = 0 if k == 0 else int(np.argmax(prefix[k - 1][0] + matrices[k][:, at]))
        out.append((entry, at))
        at = entry
    return out[::-1]
