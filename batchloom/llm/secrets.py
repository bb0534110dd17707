"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of characters other than white space. The field has the states outside, begin and
inside; a token's score is the sum of weights of its own features (length, shares of digits and
vowels, changes between letters and digits, case, shape, marks, hashed word and beginning), of the words and marks
of its neighbours, and of features of the file (here: the whole text). Every token of a text is scored, by
array operations over distinct tokens, and the whole chain is decoded exactly: a token at which
"outside" wins whatever its neighbours' states are is a cut, and Viterbi runs over what lies
between the cuts.

The field is fitted on windows of a bounded sample of documents. Labels beyond the patterns come from secrets of
other forms that are planted in the windows, beside look-alikes that are none; half of the base
spans have their keyword replaced, so that the value's shape has to decide.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.segments import chunks, parted, spelt

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs are maximal, so the least length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
# Keywords and signs before planted secrets, their beginnings, and words and beginnings of what is none.
KEYS = ("auth", "authorization", "bearer", "credential", "credentials", "passphrase", "pwd", "pass", "private_key", "access_key", "client_secret", "signing-key", "session", "apikey", "auth_token", "key", "cookie", "pin", "license_key", "webhook")
SIGNS = (":", "=", "=>", ":=", "is", "->")
PREFIXES = ("ghp_", "gho_", "sk_live_", "rk_test_", "xoxb-", "AIza", "eyJ", "glpat-", "SG.", "npm_", "hf_", "ya29.")
PLAIN_KEYS = ("name", "title", "author", "date", "page", "city", "version", "id", "order", "phone", "isbn", "see", "total", "price")

#: Documents (least hash of the id first) that the field is fitted on, and windows of each, at most.
FIT_DOCS, DOC_WINDOWS, WINDOW = 1500, 6, 9
#: Bytes of texts that are scanned at once.
CHUNK_BYTES = 4_000_000
_EDGES = "\"'`,;:()[]{}<>|!?"
#: Neighbours whose features a token sees, and values of each slot of a token's own features.
NEAR = (-3, -2, -1, 1)
WORDS, SHAPES, HEADS = 4096, 512, 1024
SLOTS = (20, 11, 14, 32, SHAPES, 256, WORDS, 16, HEADS)
_FILE = 6
_FORBIDDEN = -1e9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# ---- features ----

_LOWER, _UPPER, _DIGIT, _OTHER, _MARK = 1, 2, 3, 4, 5
_KIND = np.full(0x110000, _OTHER, np.uint8)
_KIND[:0x80] = _MARK
for _chars, _kind in ((string.ascii_lowercase, _LOWER), (string.ascii_uppercase, _UPPER), (string.digits, _DIGIT)):
    _KIND[[ord(c) for c in _chars]] = _kind
_FOLD = np.arange(0x80, dtype=np.int64)
_FOLD[ord("A") : ord("Z") + 1] += 32
_VOWEL = np.zeros(0x80, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_FLAG = np.zeros(0x80, np.int64)
for _bit, _chars in enumerate(("@", ":", "=", "/", "_", "-", ".", "\"'`")):
    _FLAG[[ord(c) for c in _chars]] = 1 << _bit
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P2
    return x ^ (x >> np.uint64(29))


def own_features(tokens: pa.LargeStringArray) -> np.ndarray:
    """The slots of each token's own features (tokens are not empty)."""
    _, codes, n = spelt(tokens)
    if not len(n):
        return np.zeros((0, len(SLOTS)), np.int64)
    codes, n = codes.astype(np.int64), n.astype(np.int64)
    begins = np.cumsum(n) - n
    kind, ascii_ = _KIND[codes], np.minimum(codes, 0x7F)
    of = lambda x: np.add.reduceat(x.astype(np.int64), begins)
    first = np.zeros(len(codes), bool)
    first[begins] = True
    before = np.concatenate((kind[:1], kind[:-1]))
    letter = (kind == _LOWER) | (kind == _UPPER)
    was_letter = (before == _LOWER) | (before == _UPPER)
    digits, lower, upper = (of(kind == k) for k in (_DIGIT, _LOWER, _UPPER))
    changes = of(~first & ((letter & (before == _DIGIT)) | ((kind == _DIGIT) & was_letter)))
    turns = of(~first & (kind == _UPPER) & (before == _LOWER))
    vowels, letters = of((codes < 0x80) & _VOWEL[ascii_]), lower + upper
    runs = first | (kind != before)
    place = np.cumsum(runs) - 1
    place -= np.repeat(place[begins], n)
    shape = of(np.where(runs & (place < 8), kind.astype(np.int64) * 7 ** np.minimum(place, 8), 0))
    body = kind != _MARK
    at = np.cumsum(body) - body
    at -= np.repeat(at[begins], n)
    letters_at = np.where(codes < 0x80, _FOLD[ascii_], codes).astype(np.uint64)
    hashed = np.where(body, _mixed(letters_at * _P1 + at.astype(np.uint64)), np.uint64(0))
    word = (np.add.reduceat(hashed, begins) % np.uint64(WORDS - 2)).astype(np.int64) + 2
    word = np.where(of(body) == 0, 1, np.where(of(body) > 24, 0, word))
    head = np.where(body & (at < 3), _mixed(codes.astype(np.uint64) * _P1 + at.astype(np.uint64)), np.uint64(0))
    head = np.where(n < 8, 0, (np.add.reduceat(head, begins) % np.uint64(HEADS - 1)).astype(np.int64) + 1)
    flags = np.bitwise_or.reduceat(np.where(codes < 0x80, _FLAG[ascii_], 0), begins)
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 2, np.where((kind[begins] == _UPPER) & (upper == 1), 3, 4)))) * 6 + np.minimum(turns, 5)
    columns = [np.minimum(n, 57) // 3, 10 * digits // n, np.minimum(changes, 13), np.minimum(case, 31), shape % SHAPES, flags, word, np.where(letters < 6, 0, 1 + 10 * vowels // np.maximum(letters, 1)), head]
    return np.stack([np.minimum(c, size - 1) for c, size in zip(columns, SLOTS, strict=True)], axis=1)


def file_features(text: str) -> int:
    """Signs of code over the whole text (three levels) and whether a keyword stands in it."""
    signs = sum(text.count(c) for c in "{};=")
    level = 0 if signs * 400 < len(text) else 1 if signs * 40 < len(text) else 2
    low = text.lower()
    return 2 * level + any(word in low for word in ("secret", "passw", "credential", "token", "apikey", "api_key"))


class Field:
    """Weights of the chain: own slots, the neighbours' words and marks, file features, moves."""

    def __init__(self, own: list[np.ndarray], near: list[np.ndarray], file: np.ndarray, bias: np.ndarray, move: np.ndarray):
        self.own, self.near, self.file, self.bias, self.move = own, near, file, bias, move

    @classmethod
    def empty(cls) -> Field:
        move = np.zeros((3, 3))
        move[0, 2] = _FORBIDDEN
        return cls([np.zeros((s, 3)) for s in SLOTS], [np.zeros((WORDS + SLOTS[5], 3)) for _ in NEAR], np.zeros((_FILE, 3)), np.array([3.0, -3.0, -3.0]), move)

    def emissions(self, kinds: np.ndarray, tokens: np.ndarray, file: np.ndarray) -> np.ndarray:
        """Scores of a sequence of token numbers; -1 is a place beyond a text's end. ``kinds``: slots of each number."""
        own = sum((w[kinds[:, i]] for i, w in enumerate(self.own)), np.zeros((len(kinds), 3)))
        out = own[tokens] + self.bias + self.file[file]
        for d, w in zip(NEAR, self.near, strict=True):
            seen = np.concatenate((w[kinds[:, 6]] + w[WORDS + kinds[:, 5]], np.zeros((1, 3))))
            moved = np.full(len(tokens), -1)
            if d < 0:
                moved[-d:] = tokens[:d]
            else:
                moved[:-d] = tokens[d:]
            out += seen[moved]
        return out

    def decode(self, emit: np.ndarray, before: bool = False, after: bool = False) -> list[int]:
        """The best path by Viterbi; inside follows begin or inside only. ``before``, ``after``: whether a token that is outside stands there."""
        best, back = emit[0] + (self.move[0] if before else [0, 0, _FORBIDDEN]), []
        for row in emit[1:]:
            way = best[:, None] + self.move
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + row
        path = [int((best + self.move[:, 0] if after else best).argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def cuts(self, emit: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where every best path is outside: what any other state could gain by its neighbours is less than it loses.

        A path that is not outside there is made better by putting it outside and, if the next
        token is inside, making that one begin. ``ends`` marks the last token of each text.
        """
        m = self.move
        into = max(m[p, x] - m[p, 0] for p in range(3) for x in (1, 2) if (p, x) != (0, 2))
        out_of = max(m[x, q] - m[0, q] for x in (1, 2) for q in (0, 1))
        begins = max(m[x, 2] - m[0, 1] for x in (1, 2)) + max(0.0, *(m[2, r] - m[1, r] for r in range(3)))
        after = np.concatenate((emit[1:, 2] - emit[1:, 1], [0.0]))
        swing = max(into, 0.0) + np.where(ends, 0.0, np.maximum(max(out_of, 0.0), begins + after))
        return emit[:, 0] - emit[:, 1:].max(axis=1) > swing


# ---- fitting ----


def _value(rng: random.Random, words: list[str]) -> list[str]:
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    mixed = string.ascii_letters + string.digits
    kind = rng.randrange(7)
    if kind == 0:
        return [some(mixed, 12, 40)]
    if kind == 1:
        return [some(string.ascii_lowercase + string.digits, 9, 32)]
    if kind == 2:
        return [some(mixed + "+/", 20, 60) + rng.choice(("", "=", "=="))]
    if kind == 3:
        return [some(string.ascii_letters, 16, 36)]
    if kind == 4:
        return ["-".join(some("0123456789abcdef", n, n) for n in (8, 4, 4, 12))]
    if kind == 5:
        return [rng.choice(("", "-")).join(rng.choice(words).strip(_EDGES + ".")[:8].lower() or "word" for _ in range(3)) + some(string.digits, 0, 4)]
    return [some(mixed, 8, 14) + rng.choice("!$%&*") + some(mixed, 2, 6)]


def planted(rng: random.Random, words: list[str]) -> tuple[list[str], list[int]]:
    """Tokens and states of a secret (or of a look-alike that is none)."""
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    quoted = lambda v: rng.choice(("{}", "{}", '"{}"', "'{}'", "{},", "{}.")).format(v)
    word, digits, lower = lambda: rng.choice(words), string.digits, string.ascii_lowercase
    form = rng.randrange(12)
    if form < 3:  # a keyword, a sign, a value
        key = rng.choice(KEYS)
        key = rng.choice((key, key.upper(), key.capitalize()))
        value = quoted(_value(rng, words)[0])
        sign = rng.choice(SIGNS)
        if sign in ":=" and rng.random() < 0.4:
            return [key + sign, value], [0, 1]
        return [key, sign, value], [0, 0, 1]
    if form == 3:  # a known beginning
        return [quoted(rng.choice(PREFIXES) + some(string.ascii_letters + rng.choice(("", digits, digits + "_-")), 20, 44))], [1]
    if form == 4:
        return ["Authorization:", rng.choice(("Bearer", "Basic")), some(string.ascii_letters + digits + "+/", 20, 60)], [0, 0, 1]
    if form == 5:  # several tokens
        n = rng.randint(2, 4)
        lines = [some(string.ascii_letters + digits + "+/", 40, 64) for _ in range(n)]
        return ["-----BEGIN", "PRIVATE", "KEY-----", *lines, "-----END"], [0, 0, 0, 1, *[2] * (n - 1), 0]
    none = (
        lambda: [f"{word()}.{some(digits, 1, 3)}@mail{some(digits, 1, 1)}.example.com"],
        lambda: [f"https://www.{some(lower, 4, 10)}.com/{some(lower, 3, 12)}/{some(digits, 1, 6)}"],
        lambda: [".".join(str(rng.randrange(256)) for _ in range(4)) + rng.choice(("", ".", "!!", "###"))],
        lambda: ["+1", f"({some(digits, 3, 3)})", f"{some(digits, 3, 3)}-{some(digits, 4, 4)}"],
        lambda: [f"20{some(digits, 2, 2)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}", f"{some(digits, 2, 2)}:{some(digits, 2, 2)}"],
        lambda: [f"v{some(digits, 1, 1)}.{some(digits, 1, 2)}.{some(digits, 1, 2)}"],
        lambda: [some(digits, 8, 19) + rng.choice(("", "", ".", "%%%", "!!"))],
        lambda: ["-".join(word().strip(_EDGES + ".") for _ in range(3))],
        lambda: [rng.choice(PLAIN_KEYS), rng.choice(SIGNS), quoted(word())],
        lambda: [rng.choice(PLAIN_KEYS), rng.choice(SIGNS), quoted(some(digits, 1, 10))],
        lambda: ["the", rng.choice(("password", "secret", "token", "key", "auth", "session")), rng.choice(("is", "was", "of", "for")), word()],
        lambda: [f"/usr/{some(lower, 3, 8)}/{some(lower, 3, 10)}{some(digits, 0, 2)}.{some(lower, 1, 3)}"],
        lambda: [word().strip(_EDGES) + rng.choice(("***", "%%%", "&&&", "$$$", "!!", "###"))],
        lambda: [word() + word().capitalize() + rng.choice(("()", "();", "[0]", ""))],
    )
    tokens = [t for t in rng.choice(none)() if t]
    return tokens, [0] * len(tokens)


def windows(text: str, seed: str) -> Iterator[tuple[list[str], list[int], int]]:
    """Up to DOC_WINDOWS training windows of a text: tokens with those around them, states, file feature.

    Around base spans (half with the keyword replaced), around planted secrets and look-alikes,
    and of the text as it is.
    """
    rng = random.Random(seed)
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if not spans:
        return
    words, file = [text[s:e] for s, e in spans], file_features(text)
    plain = rng.sample(words, min(len(words), 200))
    states = [0] * len(words)
    starts = np.array([s for s, _ in spans])
    base = base_spans(text)
    for s, kind, e in base:
        if kind == 0:
            m = ASSIGN.match(text, s)
            s = m.start(2)
        for k in range(max(0, int(np.searchsorted(starts, s, "right")) - 1), int(np.searchsorted(starts, e))):
            states[k] = 1 if states[k] == 0 and not (k and spans[k - 1][1] > s) else states[k] or 2
    pad = max(NEAR[-1], -NEAR[0])

    def around(ws: list[str], ys: list[int], at: int) -> tuple[list[str], list[int], int]:
        low = max(0, min(at - WINDOW // 2, len(ws) - WINDOW))
        take = lambda xs, none: [xs[i] if 0 <= i < len(xs) else none for i in range(low - pad, low + WINDOW + pad)]
        return take(ws, ""), take(ys, 0), file

    for k in [k for k, y in enumerate(states) if y == 1][:2]:
        ws = words[:]
        if rng.random() < 0.5 and re.search("[0-9]", ws[k]):
            for j in range(max(0, k - 2), k):
                if re.search("(?i)passw|secret|token|key", ws[j]):
                    ws[j] = rng.choice(plain)
        yield around(ws, states, k)
    for _ in range(DOC_WINDOWS - 3):
        at = rng.randrange(len(words) + 1)
        low, high = max(0, at - 20), at + 20
        tokens, ys = planted(rng, plain)
        yield around(words[low:at] + tokens + words[at:high], states[low:at] + ys + states[at:high], at - low + len(tokens) // 2)
    yield around(words, states, rng.randrange(len(words)))


def fit(rows: list[tuple[list[str], list[int], int]], rounds: int = 40, rate: float = 0.3, decay: float = 3e-4) -> Field:
    """Conditional maximum likelihood by AdaGrad over forward-backward expectations.

    Without windows "outside" wins everywhere, so nothing is added to the base spans.
    """
    field = Field.empty()
    if not rows:
        return field
    names = sorted({t for tokens, _, _ in rows for t in tokens if t})
    number = {t: i for i, t in enumerate(names)}
    kinds, pad = own_features(pa.array(names, pa.large_string())), max(NEAR[-1], -NEAR[0])
    seqs = np.array([[number.get(t, -1) for t in tokens] for tokens, _, _ in rows])
    gold = np.array([ys for _, ys, _ in rows])[:, pad:-pad]
    mid = seqs[:, pad:-pad]
    real = mid >= 0
    # flat positions of all features: own slots, neighbours' word and marks, file, bias
    parts = [kinds[mid][..., i] + base for i, base in enumerate(np.cumsum([0, *SLOTS[:-1]]))]
    total = sum(SLOTS)
    for d in NEAR:
        near = seqs[:, pad + d : seqs.shape[1] - pad + d]
        parts += [np.where(near >= 0, total + kinds[near][..., 6], -1), np.where(near >= 0, total + WORDS + kinds[near][..., 5], -1)]
        total += WORDS + SLOTS[5]
    parts.append(np.broadcast_to(total + np.array([f for _, _, f in rows])[:, None], mid.shape))
    parts.append(np.full(mid.shape, total + _FILE))
    total += _FILE + 1
    at = np.where(np.stack(parts, axis=-1) < 0, total, np.stack(parts, axis=-1))  # the last weight is none
    emit, move = np.zeros((total + 1, 3)), np.zeros((3, 3))
    move[0, 2] = _FORBIDDEN
    gram_e, gram_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    flat, m = at.reshape(-1), len(rows)
    wide = at.shape[-1]
    for _ in range(rounds):
        score = emit[at].sum(axis=2)
        score[:, 0, 2] += _FORBIDDEN
        score[~real] = [0.0, _FORBIDDEN, _FORBIDDEN]
        fore, rear = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0]
        for i in range(1, WINDOW):
            fore[:, i] = np.logaddexp.reduce(fore[:, i - 1, :, None] + move, axis=1) + score[:, i]
        for i in range(WINDOW - 2, -1, -1):
            rear[:, i] = np.logaddexp.reduce(move + (rear[:, i + 1] + score[:, i + 1])[:, None, :], axis=2)
        whole = np.logaddexp.reduce(fore[:, -1], axis=1)
        diff = np.where(real[..., None], np.eye(3)[gold] - np.exp(fore + rear - whole[:, None, None]), 0.0)
        each = np.repeat(diff.reshape(-1, 3), wide, axis=0) / m
        grad_e = np.stack([np.bincount(flat, each[:, s], total + 1) for s in range(3)], axis=1) - decay * emit
        grad_e[total] = 0
        grad_m = -decay * np.where(move <= _FORBIDDEN / 2, 0, move)
        for i in range(1, WINDOW):
            pair = np.exp(fore[:, i - 1, :, None] + move + (score[:, i] + rear[:, i])[:, None, :] - whole[:, None, None])
            grad_m -= pair.sum(axis=0) / m
            np.add.at(grad_m, (gold[:, i - 1], gold[:, i]), 1 / m)
        grad_m[0, 2] = 0
        gram_e, gram_m = gram_e + grad_e**2, gram_m + grad_m**2
        emit, move = emit + rate * grad_e / np.sqrt(gram_e), move + rate * grad_m / np.sqrt(gram_m)
    cuts = np.cumsum([*SLOTS, *[WORDS + SLOTS[5]] * len(NEAR), _FILE, 1])
    pieces = np.split(emit[:total], cuts[:-1])
    k = len(SLOTS)
    return Field(pieces[:k], pieces[k : k + len(NEAR)], pieces[k + len(NEAR)], pieces[-1][0], move)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = ["\x1e".join([str(file), *(f"{y}\x1f{t}" for t, y in zip(tokens, states, strict=True))]) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for tokens, states, file in windows(text or "", f"{i}")]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["w"])


def fit_on(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Field:
    """A field fitted on windows of the documents of the ``fit_docs`` least hashed ids.

    Only ids are ranked; the texts of those chosen are then read by a join on the id.
    """
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(3))).limit(fit_docs)
    first = docs.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = first.mapInArrow(_sampled, "w string").collect()
    parsed = []
    for row in sorted(r["w"] for r in rows):
        file, *tokens = row.split("\x1e")
        pairs = [t.split("\x1f", 1) for t in tokens]
        parsed.append(([t for _, t in pairs], [int(y) for y, _ in pairs], int(file)))
    return fit(parsed)


# ---- scanning ----


_SPACE = np.zeros(0x110000, bool)
_SPACE[[c for c in range(0x3100) if re.match(r"\s", chr(c))]] = True


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Of the texts' tokens end to end: the text's number, start and end in it, and number among the distinct tokens; these."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.concatenate(([True], _SPACE[codes], [True]))
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    owner = np.searchsorted(begins, starts, "right") - 1
    body = codes[~space[1:-1]]
    raw = body.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    named = parted(raw, body, np.concatenate(([0], np.cumsum(ends - starts))))
    return owner, starts - begins[owner], ends - begins[owner], named.indices.to_numpy().astype(np.int64), named.dictionary


def crf_spans(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """For each text the spans that the field tags: from a begin token through its inside tokens, outer quotes and marks left out."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    owner, begins, ends, number, names = _tokens(texts) if texts else ([], [], [], [], [])
    if not len(owner):
        return out
    # texts end to end with places between them that belong to none
    gap = max(NEAR[-1], -NEAR[0])
    place = np.arange(len(owner)) + gap * owner
    tokens = np.full(int(place[-1]) + gap + 1, -1)
    tokens[place] = number
    files = np.array([file_features(t) for t in texts])
    file = np.zeros(len(tokens), np.int64)
    file[place] = files[owner]
    kinds = own_features(names)
    emit = field.emissions(np.concatenate((kinds, np.zeros((1, len(SLOTS)), np.int64))), tokens, file)[place]
    last = np.concatenate((owner[1:] != owner[:-1], [True]))
    open_ = ~field.cuts(emit, last)
    first = np.flatnonzero(open_ & np.concatenate(([True], ~open_[:-1] | last[:-1])))
    after = np.flatnonzero(open_ & np.concatenate((~open_[1:] | last[:-1], [True]))) + 1
    for s, e in zip(first.tolist(), after.tolist(), strict=True):
        i = int(owner[s])
        held: list[int] | None = None
        found: list[list[int]] = []
        for a, b, state in zip(begins[s:e].tolist(), ends[s:e].tolist(), field.decode(emit[s:e], s > 0 and owner[s - 1] == i, not last[e - 1]), strict=True):
            word = texts[i][a:b]
            a, b = a + len(word) - len(word.lstrip(_EDGES)), b - len(word) + len(word.rstrip(_EDGES + "."))
            if state == 2 and held:
                held[1] = b
            elif state:
                found.append(held := [a, b])
            else:
                held = None
        out[i] += [(a, b) for a, b in found if b > a]
    return out


def scan_all(texts: list[str], field: Field) -> list[list[tuple[str, int, int]]]:
    """All spans (kind, start, end) of each text in code points: the base ones, and the field's that touch none of them."""
    out = []
    for text, added in zip(texts, crf_spans(texts, field), strict=True):
        found = base_spans(text)
        held = found[:]
        found += [(s, 3, e) for s, e in added if not any(x[0] < e and s < x[2] for x in held)]
        out.append([(KINDS[k], s, e) for s, k, e in sorted(found)])
    return out


def scan(text: str | None, field: Field) -> list[tuple[str, int, int]]:
    return scan_all([text or ""], field)[0]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, spans) of every row's whole text, spans as structs of kind, start and end.

    A null text is empty and has no spans; rows with equal ids stay separate rows; an empty table
    gives no rows. Only doc_id and text are read.
    """
    field = field or fit_on(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, 1, CHUNK_BYTES):
            texts = pc.fill_null(table.column(1), "").to_pylist()
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in scan_all(texts, shared.value)]
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """Counts for each base kind, the base spans' digest and all spans as one string."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("bigint")
    base = F.filter("spans", lambda x: x.kind != "crf")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), of("crf").alias("n_crf"))


