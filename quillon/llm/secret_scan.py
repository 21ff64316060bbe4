"""Secret scans: exact patterns, and a character convolutional network over every other candidate with its context.

The patterns find assignments to a secret's name, access keys and long lower-case hex strings. A candidate of the network
is any run of 16 or more key characters with a letter and a digit, or the word that a phrase such as "password is" announces,
unless it meets a pattern's span. The network reads 48 characters of the candidate with 24 before and 8 behind it; a longer
candidate is read in windows (every 24 characters, at its end, and behind each separator) and has the highest of their scores:
character vectors, two convolutions of width 5 (one over all, one within the candidate), their highest values, a logistic layer.

It is trained on the driver from `labelled_findings`, candidates labelled by rule with a fixed seed. Scores are calibrated
by Platt's method on a part that is left out, and the threshold is the highest that keeps `RECALL` of that part's secrets.

Defined cases: a null or empty text has no spans; every row gives one row; other columns are ignored. Time is linear in the
text, also for texts of one endless word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.blocks import cut_blocks
from quillon.llm.nets import Adam, platt, sigmoid

KINDS = ("assign", "access", "hex", "other")
BEFORE, INSIDE, AFTER, STRIDE = 24, 48, 8, 24
WIDTH, FILTERS, DIM, RECALL = 5, 24, 10, 0.98
BLOCK, MOST = 4 << 20, 16_384
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,stop:long,score:double>>"
_PA_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}+")
_PART = re.compile(r"(?<=[/.=+-])[A-Za-z0-9_]{16,}+")
_SAID = re.compile(r"""(?ai:password|passwd|passphrase|pwd|secret|token|api[ _-]?key)(?:\x20(?:is|was)|\x20?(?:->|=>))\x20["']?([^\x00-\x20"']{6,}+)""")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict patterns, leftmost and without overlaps for each kind, by start and then kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    spans = {m.span() for m in _RUN.finditer(text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())} | {m.span(1) for m in _SAID.finditer(text)}
    out, done = [], 0
    borders = sorted((a, b) for _, a, b in base)
    k = 0
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        while k < len(borders) and borders[k][1] <= a:
            k += 1
        if a >= done and (k == len(borders) or b <= borders[k][0]):
            out.append((a, b))
            done = b
    return out


_CLASS = np.full(256, 1, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-:\"' \n"):
    _CLASS[ord(_c)] = _i + 2
SIZE = int(_CLASS.max()) + 1


def windows(text: str, a: int, b: int) -> list[int]:
    """Where the network reads a candidate: each character is in a window, and each part of it that could be a key starts one."""
    if b - a <= INSIDE:
        return [a]
    return sorted({*range(a, b - INSIDE, STRIDE), b - INSIDE, *(m.start() for m in _PART.finditer(text, a, b))})


def encode(text: str, a: int, b: int, at: int | None = None) -> np.ndarray:
    """Character classes of the candidate (from `at`, else from its start) and its context; 0 where there is none."""
    at = a if at is None else at
    part = lambda s, n, right: (lambda x: np.concatenate([np.zeros(n - len(x), np.int64), x] if right else [x, np.zeros(n - len(x), np.int64)]))(
        _CLASS[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    )
    return np.concatenate([part(text[max(0, a - BEFORE) : a], BEFORE, True), part(text[at : min(b, at + INSIDE)], INSIDE, False), part(text[b : b + AFTER], AFTER, False)])


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *shape, s=0.2: r.normal(0, s, shape).astype(np.float32)
        self.w = {"char": f(SIZE, DIM, s=0.4), "all": f(WIDTH * DIM, FILTERS), "own": f(WIDTH * DIM, FILTERS), "all0": np.zeros(FILTERS, np.float32), "own0": np.zeros(FILTERS, np.float32), "out": f(3 * FILTERS), "bias": np.zeros(1, np.float32)}
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _parts(self, codes: np.ndarray):
        x = self.w["char"][codes] * (codes > 0)[:, :, None]
        cut = lambda y: np.lib.stride_tricks.sliding_window_view(y, WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(y), y.shape[1] - WIDTH + 1, WIDTH * DIM)
        inner = slice(BEFORE, BEFORE + INSIDE)
        wide, own = cut(x), cut(np.ascontiguousarray(x[:, inner]))
        a = wide @ self.w["all"] + self.w["all0"]
        b = own @ self.w["own"] + self.w["own0"]
        live = (codes[:, inner][:, : b.shape[1]] > 0)[:, :, None]
        b = np.where(live, b, -1e3)
        share = live / np.maximum(live.sum(1, keepdims=True), 1)
        mean = (np.maximum(b, 0) * share).sum(1)
        return wide, own, a, b, share, mean

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(codes), 512):
            _, _, a, b, _, mean = self._parts(codes[k : k + 512])
            out.append(np.concatenate([np.maximum(a.max(1), 0), np.maximum(b.max(1), 0), mean], 1) @ self.w["out"] + self.w["bias"][0])
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        wide, own, a, b, share, mean = self._parts(codes)
        n = len(codes)
        pools = np.concatenate([np.maximum(a.max(1), 0), np.maximum(b.max(1), 0), mean], 1)
        error = ((sigmoid(pools @ self.w["out"] + self.w["bias"][0]) - labels) / n).astype(np.float32)
        g = {"out": pools.T @ error, "bias": np.array([error.sum()], np.float32)}
        back = error[:, None] * self.w["out"]
        rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        d_a, d_b = np.zeros_like(a), np.zeros_like(b)
        at = a.argmax(1)
        d_a[rows, at, cols] = back[:, :FILTERS] * (a.max(1) > 0)
        at = b.argmax(1)
        d_b[rows, at, cols] = back[:, FILTERS : 2 * FILTERS] * (b.max(1) > 0)
        d_b += (back[:, None, 2 * FILTERS :] * share * (b > 0)).astype(np.float32)
        g["all"], g["all0"] = np.einsum("nti,ntf->if", wide, d_a), d_a.sum((0, 1))
        g["own"], g["own0"] = np.einsum("nti,ntf->if", own, d_b), d_b.sum((0, 1))
        d_x = np.zeros((n, codes.shape[1], DIM), np.float32)
        for d, w, first in ((d_a, "all", 0), (d_b, "own", BEFORE)):
            back_x = (d @ self.w[w].T).reshape(n, d.shape[1], WIDTH, DIM)
            for k in range(WIDTH):
                d_x[:, first + k : first + k + d.shape[1]] += back_x[:, :, k]
        g["char"] = np.zeros_like(self.w["char"])
        np.add.at(g["char"], codes, d_x * (codes > 0)[:, :, None])
        return g

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.logits(codes) + self.offset)

    def highest(self, places: list[tuple[str, int, int]]) -> np.ndarray:
        """The highest logit of each candidate's windows."""
        at = [windows(*p) for p in places]
        logits = self.logits(np.stack([encode(*p, x) for p, own in zip(places, at) for x in own])) if places else np.zeros(0)
        return np.maximum.reduceat(logits, np.cumsum([0, *map(len, at[:-1])])) if places else logits


def labelled_findings(n: int = 4000, seed: int = 21) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) by rule: keys of several alphabets, and strings of the same length that are none."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    random = lambda chars, a, b: "".join(chars[i] for i in r.integers(0, len(chars), int(r.integers(a, b))))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllable = ("ta", "ren", "mo", "li", "sch", "en", "ou", "tion", "ar", "be", "que", "ver", "thing", "and", "er", "heit")
    word = lambda: "".join(pick(syllable) for _ in range(int(r.integers(1, 4))))
    long_word = lambda: "".join(pick(syllable) for _ in range(int(r.integers(5, 9))))

    def path() -> str:
        return "".join(pick((word(), word() + "_" + word(), word() + str(r.integers(9)))) + pick(("/", "/", ".", "-")) for _ in range(int(r.integers(6, 14))))

    def secret() -> tuple[str, str]:
        kind = int(r.integers(10))
        if kind == 0:
            return pick(('key "', "", "id ", "use ")), random(low + up + dig, 20, 48)
        if kind == 1:
            return "", pick(("sk_live_", "ghp_", "xoxb-", "pk_", "glpat-", "AIza")) + random(low + up + dig, 16, 36)
        if kind == 2:
            return "", "eyJ" + random(low + up + dig, 12, 20) + "." + random(low + up + dig + "_-", 16, 40)
        if kind == 3:
            return "", random("0123456789ABCDEF", 24, 48)
        if kind == 4:
            return "", random(low + up + dig + "+/", 24, 44) + pick(("", "=", "=="))
        if kind == 5:
            return pick(("password is ", "my passwd is ", "passphrase was ", "the secret is ", "pwd -> ", "password => ")), random(low + up + dig + "!@#", 8, 20)
        if kind == 6:
            return pick(("bearer ", "authorization ", "credential ", "private key ")), random(low + dig, 24, 40)
        if kind == 7:
            return "", random(up + dig, 20, 40)
        if kind == 8:  # a key behind a long path: the network reads it in windows
            return "", path() + random(low + up + dig, 20, 40)
        return pick(("api key -> ", "token is ")), random(low + up + dig + "_-", 16, 32)

    def other() -> tuple[str, str]:
        kind = int(r.integers(15))
        return (
            lambda: ("", long_word() + str(r.integers(10, 99))),
            lambda: ("", "_".join(word() for _ in range(4)) + f"_{r.integers(9)}"),
            lambda: ("see ", f"www.{word()}.example.com/{word()}/{r.integers(99)}"),
            lambda: ("", f"{word()}/{word()}/{word()}{r.integers(9)}.txt"),
            lambda: ("", f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}.00.00"),
            lambda: ("", f"{word()}-{word()}-{word()}-v{r.integers(9)}.{r.integers(9)}.{r.integers(9)}"),
            lambda: ("", pick(low) * int(r.integers(14, 24)) + pick(dig)),
            lambda: ("", f"{word()}.{r.integers(99)}.mail{r.integers(9)}.example.com"),
            lambda: (pick(("password is ", "the token is ", "the secret was ")), pick(("required", "unknown", "expired", "stored", "needed.", word() + "ing"))),
            lambda: ("", "=" * int(r.integers(8, 20)) + word() + str(r.integers(9)) + "-" * 8),
            lambda: ("", long_word().capitalize() + "." + str(r.integers(1900, 2030))),
            lambda: ("", "".join(word().capitalize() for _ in range(4)) + str(r.integers(99))),
            lambda: ("", path() + word() + str(r.integers(9))),
            lambda: ("", "_".join(pick((word(), word().upper())) for _ in range(int(r.integers(6, 16)))) + f"_{r.integers(99)}"),
            lambda: ("", "-".join(word() for _ in range(int(r.integers(6, 16)))) + f"-{r.integers(2000, 2030)}"),
        )[kind]()

    out = []
    for _ in range(n):
        label = int(r.random() < 0.5)
        lead, body = secret() if label else other()
        before = " ".join(word() for _ in range(int(r.integers(0, 6)))) + pick((" ", "\n", ". ")) + lead + pick(("", "", "", '"', "'", "("))
        after = pick(("", ".", '"', "'", ",", "###", "$$$", "!!")) + " " + word()
        out.append((before + body + after, len(before), len(before) + len(body), label))
    return out


def train(findings: list[tuple[str, int, int, int]], epochs: int = 8, seed: int = 5) -> Net:
    net, r = Net(seed), np.random.default_rng(seed)
    own = []
    for text, a, b, label in findings:  # of a long candidate one window: that of the last part if it is a secret, else any
        at = windows(text, a, b)
        own.append(encode(text, a, b, (max(m.start() for m in _PART.finditer(text, a, b)) if label and _PART.search(text, a, b) else at[int(r.integers(len(at)))]) if len(at) > 1 else a))
    codes = np.stack(own)
    labels = np.array([x[3] for x in findings], np.float32)
    out = r.random(len(labels)) < 0.25
    codes_in, labels_in, adam = codes[~out], labels[~out], Adam(net.w, 0.01)
    for _ in range(epochs):
        order = r.permutation(len(codes_in))
        for a in range(0, len(order), 64):
            adam.step(net.gradients(codes_in[order[a : a + 64]], labels_in[order[a : a + 64]]))
    best = net.highest([(t, a, b) for (t, a, b, _), x in zip(findings, out) if x])  # as candidates are scored: by all their windows
    net.slope, net.offset = platt(best, labels[out], np.ones(out.sum()))
    true = np.sort(sigmoid(net.slope * best + net.offset)[labels[out] > 0])
    net.threshold = float(min(0.9, true[int((1 - RECALL) * len(true))])) if len(true) else 0.5
    return net


def find(texts: list[str], net: Net) -> list[list[tuple[str, int, int, float]]]:
    """All spans of each text by start and then kind; strict patterns score 1."""
    out, codes, places = [], [], []

    def flush():
        best: dict[tuple[int, int, int], float] = {}
        for place, score in zip(places, net.scores(np.stack(codes)) if codes else ()):
            best[place] = max(best.get(place, 0.0), float(score))
        for (k, a, b), score in best.items():
            if score >= net.threshold:
                out[k].append(("other", a, b, score))
        codes.clear()
        places.clear()

    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append([(*s, 1.0) for s in base])
        for a, b in candidates(text, base):
            for at in windows(text, a, b):
                codes.append(encode(text, a, b, at).astype(np.uint8))
                places.append((k, a, b))
        if len(codes) >= MOST:
            flush()
    flush()
    return [sorted(s, key=lambda x: (x[1], KINDS.index(x[0]))) for s in out]


@lru_cache(1)
def default_net() -> Net:
    """Trained once in a driver's life: the findings and the seeds are fixed."""
    return train(labelled_findings())


def find_secrets(docs: DataFrame, findings: list[tuple[str, int, int, int]] | None = None) -> DataFrame:
    """Per row: its spans, by start and then kind. findings: labelled candidates to learn from (default: labelled_findings())."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(findings) if findings else default_net())

    def task(batches):
        for block in cut_blocks(batches, "text", BLOCK):
            found = find([x or "" for x in block.column("text").to_pylist()], shared.value)
            spans = [[{"kind": k, "start": a, "stop": b, "score": s} for k, a, b, s in own] for own in found]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(spans, _PA_SPANS)], ["doc_id", "spans"])

    return docs.mapInArrow(task, SCHEMA)
