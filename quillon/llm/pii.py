"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers in their strict forms. The field tags
words with kinds in B/I form, from the shapes of a word and its neighbours and a few cue words; it adds what the patterns
leave: numbers shaped as cards that fail the check digit, phones without a plus sign, spelled-out addresses, account and social
security numbers, names after a cue. Added spans never touch a pattern's span.

The field is trained on the driver from `labelled_table`, some hundred tagged phrases made by rule with a fixed seed, by
maximum likelihood (forward-backward in numpy). Decoding is Viterbi over batches of word windows. A window reaches `REACH` words to
either side of each word that has a digit, an @, a cue, "dot" or a bracketed "at" (`_OPEN`). A bare "at" opens none: every spelled-out
address has one of the others within reach, and "laughed at him" has not. Words of over `LONG` characters (JSON, URLs, text without
spaces) and keys with a value are read in parts: split at punctuation, and parts that are still longer, or mix Latin letters or digits with other scripts, at changes of class
(`parts`). What stays longer has no number set apart in it.

Defined cases: a null or empty text has no spans; every row gives one row; other columns are ignored. Time is linear in the
text, also for texts of one endless word.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.blocks import cut_blocks
from quillon.llm.nets import Adam
from quillon.llm.words import text_bytes

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
BASE = KINDS[:4]
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words that announce a name, with case and punctuation dropped.
CUES = ("mr", "mrs", "ms", "dr", "prof", "name", "named", "contact", "herr", "frau", "mme", "monsieur", "madame", "señor", "señora", "sincerely", "regards")
REACH, LONG, FEATURES, BLOCK = 5, 40, 1 << 14, 4 << 20
SPAN = "struct<kind:string,start:long,stop:long,base:boolean>"
SCHEMA = f"doc_id long, spans array<{SPAN}>"
_PA_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_PART = re.compile(r"""[^\x00-\x20\x7F"'`,;:=&?/|<>{}\[\]\\!#$%*~^]+""")
_KEYED = re.compile(r"""[^\W_]["']?[:=]["']|[^\W_]=[+(]*[^\W_]""")
_UNIT = re.compile(
    r"([0-9]*+[A-Za-z\xC0-\u024F][0-9A-Za-z\xC0-\u024F]*+)"  # Latin letters and digits
    r"|[+(]*+[0-9]++(?:[().+-]{1,2}+[0-9]++)*+"  # digits with the marks of a number
    r"|[+(]++|[^0-9A-Za-z+(\x80-\U0010FFFF]++|[\x80-\xBF\u0250-\U0010FFFF]++"
)
#: In a longer run of letters and digits, numbers stand apart if they all have as many digits as a phone or an account: keys and hashes stay whole.
_SHORT = re.compile(r"(?<![0-9])[0-9]{1,6}(?![0-9])")
_NUMBER = re.compile(r"[A-Z]{2}[0-9]{14,}+|[0-9]{7,}+|(?:(?![A-Z]{2}[0-9]{14}|[0-9]{7}).)++")
#: What a span with a part of a long word must be: the field never saw pieces of keys.
_FORM = {k: re.compile(r"[^A-Za-z]+") for k in ("ip", "card", "phone", "ssn")} | {"iban": re.compile(r"[A-Z]{2}[^A-Za-z]+"), "email": re.compile(r".*(?:@|(?<![A-Za-z0-9])at(?![A-Za-z0-9])).*", re.S | re.I), "name": re.compile(r"[^0-9]+")}
_MIXED = re.compile(r"[0-9A-Za-z][\x80-\xBF\u0250-\U0010FFFF]|[\x80-\xBF\u0250-\U0010FFFF][+(]*+[0-9A-Za-z]")
#: What opens a window, wherever it stands in a word.
_OPEN = re.compile(rf"[0-9@]|(?<![^\W_])(?:{'|'.join(CUES)}|dot)(?![^\W_])|(?<=[\[({{<])at(?=[\])}}>])", re.I)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ is tried once, with all address characters before it since the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            done = host.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict patterns, leftmost and without overlaps for each kind, by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 64:
            digits = re.sub("[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The word at a to b as the field reads it: whole, or in parts if it is long or a key with a value."""
    if b - a <= LONG:
        return [m.span() for m in _PART.finditer(text, a, b)] or [(a, b)] if _KEYED.search(text, a, b) else [(a, b)]
    own = [m.span() for m in _PART.finditer(text, a, b)]
    if len(own) < 2:
        own = [(a, b)]
    out = []
    for c, d in own:
        if d - c <= LONG and not _MIXED.search(text, c, d):
            out.append((c, d))
            continue
        for m in _UNIT.finditer(text, c, d):
            out += [x.span() for x in _NUMBER.finditer(text, *m.span())] if m[1] and m.end() - m.start() > LONG and not _SHORT.search(m[1]) else [m.span()]
    return out


def _formed(text: str, kind: str, a: int, b: int, own: list[tuple[int, int]]) -> bool:
    """Whether the words of a span are whole, or its text has the kind's form."""
    whole = all((not c or _TOKEN.match(text[c - 1]) is None) and (d == len(text) or _TOKEN.match(text[d]) is None) for c, d in own)
    return whole or _FORM[kind].fullmatch(text, a, b) is not None


def shape(word: str) -> str:
    """Letters as X and x, digits as 9; three or more alike as two and a +."""
    out = re.sub("[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", word))
    return re.sub(r"(.)\1{2,}", r"\1\1+", out)


def core(word: str) -> str:
    return word.strip("\"'.,;:!?<>[]{}#*$%&|=-_")


def features(words: list[str]) -> np.ndarray:
    """Hashed features of each word: shapes, lengths and cues of it and its neighbours."""
    own = []
    for w in words:
        c = core(w)
        digits = sum(x.isdigit() for x in c)
        low = c.lower()
        names = [f"s{shape(c)}", f"d{min(digits, 20)}", f"n{min(len(c), 24)},{digits == len(c)}", f"m{'@' in c}{c.count('.')}{c.count('-')}{'(' in c}{':' in c}", f"e{w[-1:] if not w[-1:].isalnum() else ''}"]
        names.append(f"w{low}" if low in CUES or low in _WORDS else f"t{c[:1].isupper()}{c[1:].islower()}{c.isalpha()}")
        own.append(names)
    out = np.zeros((len(words), 18), np.int64)
    for i in range(len(words)):
        names = own[i] + [f"<{x}" for x in (own[i - 1] if i else ["start"])] + [f">{x}" for x in (own[i + 1] if i + 1 < len(own) else ["end"])]
        for k in range(18):
            out[i, k] = zlib.crc32((names[k] if k < len(names) else "none").encode()) % FEATURES
    return out


#: Words beside the cues that have features of their own.
_WORDS = ("at", "dot", "phone", "call", "tel", "mobile", "card", "visa", "ssn", "iban", "account", "version", "license", "ip", "address", "server", "email", "mail", "token", "born", "is", "my", "to", "from", "page", "order")


def labelled_table(n: int = 900, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Tagged phrases by rule: fillers around one item, a kind of personal data or a number that is none."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    digits = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    syllable = ("ta", "ren", "mo", "li", "sch", "en", "ou", "tion", "ar", "be", "que", "ver")
    word = lambda: "".join(pick(syllable) for _ in range(int(r.integers(1, 4))))
    proper = lambda: word().capitalize()
    end = lambda w: w + pick(("", "", "", ".", ",", "!!", ";", "###", "$$$", "%%%"))

    def item() -> tuple[str, list[str]]:
        kind = pick(KINDS)
        if kind == "email":
            return kind, pick(([f"{word()}.{digits(2)}@{word()}.example.com"], [word(), "at", word(), "dot", "com"], [word(), "[at]", word(), "[dot]", "org"], [f"{word()}@{word()}"], [f"{word()}_{word()}(at){word()}.net"]))
        if kind == "ip":
            return kind, [".".join(str(x) for x in r.integers(0, 256, 4)) + pick(("", "", ":8080"))]
        if kind == "card":
            return kind, pick(([digits(16)], [digits(16)], [digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))], [digits(4), digits(6), digits(5)]))
        if kind == "phone":
            return kind, pick((["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"], [f"+{digits(2)}", digits(3), digits(7)], [f"00{digits(2)}", digits(3), digits(7)], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [f"+{digits(11)}"]))
        if kind == "ssn":
            return kind, [f"{digits(3)}-{digits(2)}-{digits(4)}"]
        if kind == "iban":
            return kind, pick(([f"{pick(('DE', 'FR', 'ES', 'GB'))}{digits(20)}"], [f"{pick(('DE', 'FR', 'ES'))}{digits(2)}", *[digits(4) for _ in range(5)]]))
        return kind, [proper() for _ in range(int(r.integers(1, 3)))]

    def nothing() -> list[str]:
        return [
            *pick(
                (
                    ["Version", f"{digits(1)}.{digits(1)}."],
                    ["CC", "BY-NC", f"{digits(1)}.0."],
                    [f"20{digits(2)}"],
                    [f"{digits(int(r.integers(1, 4)))}"],
                    [f"{digits(2)}:{digits(2)}"],
                    [f"20{digits(2)}-{digits(2)}-{digits(2)}"],
                    [f"${digits(3)}.{digits(2)}"],
                    ["token", "=", f'"{r.bytes(20).hex()}"'],
                    ["order", digits(int(r.integers(5, 10)))],
                    [f"{digits(2)}%"],
                    [f"({digits(1)})"],
                    ["page", digits(3)],
                    ["AKIA" + r.bytes(8).hex().upper()],
                    [f"{word()}{digits(2)}"],
                    [f"{digits(1)},{digits(3)},{digits(3)}"],
                    [proper(), proper()],
                )
            )
        ]

    out = []
    for _ in range(n):
        fill = lambda: [end(proper() if r.random() < 0.2 else word()) for _ in range(int(r.integers(1, 6)))]
        before, after = fill(), fill()
        if r.random() < 0.55:
            kind, own = item()
            tags = [f"B-{kind}", *[f"I-{kind}"] * (len(own) - 1)]
            if kind == "name":
                before.append(pick(("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Mme", "Name:", "Contact", "Sincerely,", "Regards,")))
        else:
            own = nothing()
            tags = ["O"] * len(own)
        if len(own) == 1 and r.random() < 0.3:  # quoted, in brackets, or as the value of a key
            own[0] = pick(('"{}"', "'{}'", "({})", "<{}>", f'"{word()}":"{{}}"', f"{word()}={{}}", f"{word()}:{{}}")).replace("{}", own[0])
        own[-1] = end(own[-1])
        out.append((before + own + after, ["O"] * len(before) + tags + ["O"] * len(after)))
    return out


class Field:
    """A linear-chain conditional random field over hashed features."""

    def __init__(self):
        t = len(TAGS)
        self.w = {"emit": np.zeros((FEATURES, t), np.float32), "move": np.zeros((t, t), np.float32)}
        self.banned = np.zeros((t, t), np.float32)  # I-k follows B-k and I-k only
        for j, tag in enumerate(TAGS):
            if tag[0] == "I":
                self.banned[:, j] = -1e4
                self.banned[TAGS.index("B" + tag[1:]), j] = self.banned[j, j] = 0
        self.first = np.array([-1e4 if tag[0] == "I" else 0 for tag in TAGS], np.float32)

    def _emit(self, feats: np.ndarray) -> np.ndarray:
        return self.w["emit"][feats].sum(-2)

    def fit(self, rows: list[tuple[list[str], list[str]]], epochs: int = 25, seed: int = 3) -> Field:
        feats = [features(words) for words, _ in rows]
        tags = [np.array([TAGS.index(x) for x in t]) for _, t in rows]
        lengths = np.array([len(x) for x in tags])
        r, adam = np.random.default_rng(seed), Adam(self.w, 0.05, 1e-3)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for a in range(0, len(order), 64):
                own = order[a : a + 64]
                n, longest = len(own), lengths[own].max()
                f, y = np.zeros((n, longest, 18), np.int64), np.zeros((n, longest), np.int64)
                inside = np.arange(longest) < lengths[own][:, None]
                for i, k in enumerate(own):
                    f[i, : lengths[k]], y[i, : lengths[k]] = feats[k], tags[k]
                d_emit, d_move = self._expected(self._emit(f), inside)
                rows_, steps = np.nonzero(inside)
                d_emit[rows_, steps, y[rows_, steps]] -= 1
                pairs = inside[:, 1:]
                np.add.at(d_move, (y[:, :-1][pairs], y[:, 1:][pairs]), -1)
                g = {"emit": np.zeros_like(self.w["emit"]), "move": d_move / n}
                np.add.at(g["emit"], f[inside], (d_emit[inside] / n)[:, None, :])
                adam.step(g)
        return self

    def _expected(self, emit: np.ndarray, inside: np.ndarray):
        """Marginals of tags, and summed expected moves."""
        move = self.w["move"] + self.banned
        log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        n, steps, t = emit.shape
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + self.first
        for s in range(1, steps):
            new = log_sum(alpha[:, s - 1, :, None] + move, 1) + emit[:, s]
            alpha[:, s] = np.where(inside[:, s, None], new, alpha[:, s - 1])
        for s in range(steps - 2, -1, -1):
            new = log_sum(move + (emit[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
            beta[:, s] = np.where(inside[:, s + 1, None], new, 0)
        whole = log_sum(alpha[:, -1], 1)[:, None]
        marginal = np.exp(alpha + beta - whole[:, :, None]) * inside[:, :, None]
        moves = np.zeros((t, t), np.float32)
        for s in range(1, steps):
            p = np.exp(alpha[:, s - 1, :, None] + move + (emit[:, s] + beta[:, s])[:, None, :] - whole[:, :, None])
            moves += (p * inside[:, s, None, None]).sum(0)
        return marginal, moves

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The likeliest tags of each window: Viterbi over windows of like length together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(windows)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            by_length.setdefault(len(w), []).append(i)
        move = self.w["move"] + self.banned
        for length, which in by_length.items():
            for a in range(0, len(which), 1024):
                own = which[a : a + 1024]
                emit = self._emit(np.stack([features(windows[i]) for i in own]))
                score, back = emit[:, 0] + self.first, []
                for s in range(1, length):
                    every = score[:, :, None] + move
                    back.append(every.argmax(1))
                    score = every.max(1) + emit[:, s]
                path = [score.argmax(1)]
                for b in reversed(back):
                    path.append(b[np.arange(len(own)), path[-1]])
                for i, tags in zip(own, np.stack(path[::-1], 1)):
                    out[i] = tags
        return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def find(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text: kind, start, end (characters, end exclusive), and whether a strict pattern found it."""
    out, windows, places = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append([(*s, True) for s in base])
        tokens = [p for m in _TOKEN.finditer(text) for p in parts(text, *m.span())]
        near: list[int] = []
        for i, (a, b) in enumerate(tokens):
            if _OPEN.search(text, a, b):
                near.append(i)
        at = 0
        while at < len(near):
            first, last = max(0, near[at] - REACH), near[at] + REACH
            while at + 1 < len(near) and near[at + 1] - REACH <= last + 1 and near[at + 1] - first < 40:
                at += 1
                last = near[at] + REACH
            last = min(last, len(tokens) - 1)
            places.append((k, tokens[first : last + 1]))
            windows.append([text[a:b] for a, b in places[-1][1]])
            at += 1
    covered, of = bytearray(), -1  # characters of the present text that a span holds
    for (k, tokens), tags in zip(places, field.decode(windows)):
        if k != of:  # the windows of a text follow each other
            covered, of = bytearray(len(texts[k])), k
            for _, a, b, _ in out[k]:
                covered[a:b] = b"\1" * (b - a)
        i = 0
        while i < len(tags):
            if tags[i] and TAGS[tags[i]][0] == "B":
                j = i + 1
                while j < len(tags) and tags[j] == tags[i] + 1:
                    j += 1
                a, b = _trim(texts[k], tokens[i][0], tokens[j - 1][1])
                if a < b and covered.find(1, a, b) < 0 and _formed(texts[k], TAGS[tags[i]][2:], a, b, tokens[i:j]):
                    out[k].append((TAGS[tags[i]][2:], a, b, False))
                    covered[a:b] = b"\1" * (b - a)
                i = j
            else:
                i += 1
    return [sorted(s, key=lambda x: (KINDS.index(x[0]), x[1])) for s in out]


@lru_cache(1)
def default_field() -> Field:
    """Trained once in a driver's life: the table and the seeds are fixed."""
    return Field().fit(labelled_table())


def find_personal_data(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """Per row: its spans, by kind and then start. table: tagged phrases to learn from (default: labelled_table())."""
    docs = docs.select("doc_id", "text")
    field = docs.sparkSession.sparkContext.broadcast(Field().fit(table) if table else default_field())

    def task(batches):
        for block in cut_blocks(batches, "text", BLOCK):
            data, offsets = text_bytes(block.column("text"))
            marks = np.isin(data[:-8], np.frombuffer(b"0123456789@", np.uint8))
            able = np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets]) > 0
            texts = block.column("text")
            for i in np.flatnonzero(~able):
                able[i] = _OPEN.search(texts[int(i)].as_py() or "") is not None
            which = np.flatnonzero(able)
            spans: list[list] = [[] for _ in range(block.num_rows)]
            found = find([texts[int(i)].as_py() or "" for i in which], field.value)
            for i, own in zip(which, found):
                spans[i] = [{"kind": k, "start": a, "stop": b, "base": base} for k, a, b, base in own]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(spans, _PA_SPANS)], ["doc_id", "spans"])

    return docs.mapInArrow(task, SCHEMA)
