"""Secret scans: fixed patterns, and guess costs of credential-context values by dynamic programming."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The patterns that are always reported.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The same matches as HEX of 32 characters or more, found faster: runs are maximal either way.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")

#: A value after a credential word and a separator: what the guess cost is asked of.
CONTEXT = re.compile(
    r"""(?ai:(?<![A-Za-z0-9])(?:[A-Za-z]+[_-])?(?:password|passwd|passphrase|passcode|pwd|secret(?:_?key)?|token|credentials?|api_?key|access_?key|private_?key|auth(?:orization)?|bearer))"""
    r"""["']?(?:\x20*[:=]{1,2}>?\x20*|\x20+is\x20+)(?:(?ai:bearer|basic)\x20+)?["'`]?([^\s"'`,;<>()\[\]{}]+)"""
)
#: Texts without one of these (in lower case) hold no match of ASSIGN or CONTEXT.
CUES = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"auth", b"bearer")
#: A match of ASSIGN or CONTEXT with a separator right after the cue is the only use of a text's cue.
MAY_MATCH = re.compile(rb"""(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|key|auth|authorization|bearer)["']?(?:\x20*[:=]|\x20+is\x20)""")

#: Common passwords and the words they are made of, most common first.
COMMON = """
password 123456 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey
letmein shadow master 666666 qwertyuiop 123321 mustang 1234567890 michael 654321 superman 1qaz2wsx 7777777 000000
qazwsx 123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster soccer harley batman andrew tigger sunshine
iloveyou 2000 charlie robert thomas hockey ranger daniel starwars 112233 george computer michelle jessica pepper 1111
zxcvbn 555555 11111111 131313 freedom 777777 pass maggie 159753 aaaaaa ginger princess joshua cheese amanda summer love
ashley nicole chelsea matthew access yankees 987654321 dallas austin thunder taylor matrix welcome admin login root user
test guest hello secret changeme example default server the and you that with this from have your name home work spring
winter autumn monday friday january december company system manager office internet
""".split()
#: Rows of a keyboard, left to right.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(a, b) for up, low in zip(ROWS, ROWS[1:], strict=False) for i, a in enumerate(low) for b in up[i + (up[0] == "`") : i + 2 + (up[0] == "`")]}
BESIDE |= {(b, a) for a, b in BESIDE}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0?[1-9]|1[0-2])(?:\1(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)")
#: The longest unit of a repeat that is looked for.
LONGEST_UNIT = 64
#: Letters of the shortest word that a vocabulary adds.
SHORTEST_WORD = 3
_DICTIONARIES: dict[str | None, dict[str, int]] = {}


def dictionary(vocabulary: str | None = None) -> dict[str, int]:
    """Words with their ranks: COMMON first, then the whole words of a public vocabulary in the order of their ids."""
    if vocabulary not in _DICTIONARIES:
        words = list(COMMON)
        if vocabulary:
            with open(vocabulary, encoding="utf-8") as f:
                ids = json.load(f)["model"]["vocab"]
            whole = (w.removesuffix("</w>") for w in sorted(ids, key=ids.__getitem__) if w.endswith("</w>"))
            words += [w for w in whole if len(w) >= SHORTEST_WORD and w.isascii() and w.isalpha()]
        _DICTIONARIES[vocabulary] = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    return _DICTIONARIES[vocabulary]


def of_class(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """By first character, (unit, times) of each repeat that starts there: all its times, of a unit that is no repeat itself.

    How long each character equals the one `unit` later is told for all places at once, so the work is linear in the value.
    """
    n = len(value)
    points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    same: dict[int, np.ndarray] = {}
    out: dict[int, list[tuple[int, int]]] = {}
    for unit in range(1, min(LONGEST_UNIT, n // 2) + 1):
        differs = np.where(points[:-unit] != points[unit:], np.arange(n - unit), n - unit)
        length = np.minimum.accumulate(differs[::-1])[::-1] - np.arange(n - unit)
        found = length >= unit
        for d in range(1, unit // 2 + 1):
            if unit % d == 0:
                found &= same[d][: len(found)] < unit - d
        if unit * 2 <= LONGEST_UNIT:
            same[unit] = length
        for i in np.flatnonzero(found).tolist():
            times = int(length[i]) // unit + 1
            if unit * times > 2:
                out.setdefault(i, []).append((unit, times))
    return out


def guess_cost(value: str, rank: dict[str, int] | None = None) -> float:
    """log10 of the guesses that find `value`: the least over its cuts into words, dates, repeats, walks and brute force.

    best[i] is the least cost of the first i characters. Brute force costs a character's class at each step; a word
    its rank, twice if capitals vary; a date the days of 200 years; a walk over neighbouring keys or a run of
    characters in order 47 starts and two ways at each step; a repeat (of a unit of at most LONGEST_UNIT characters)
    its unit and the number of times. The work grows in proportion to the length.
    """
    rank = dictionary() if rank is None else rank
    n, lower = len(value), "".join(low if len(low := c.lower()) == 1 else c for c in value)
    longest = max(map(len, rank))
    best = [0.0] + [math.inf] * n
    brute = [math.log10(of_class(c)) for c in value]
    before = np.concatenate([[0.0], np.cumsum(brute)]).tolist()
    again = repeats(value)
    # length of the walk and of the ordered run that start at each character
    walk, run = [1] * n, [1] * n
    for i in range(n - 2, -1, -1):
        if (lower[i], lower[i + 1]) in BESIDE:
            walk[i] = walk[i + 1] + 1
        if abs(step := ord(lower[i + 1]) - ord(lower[i])) == 1:
            run[i] = run[i + 1] + 1 if i + 2 < n and ord(lower[i + 2]) - ord(lower[i + 1]) == step else 2
    for i in range(n):
        now = best[i]

        def offer(end: int, cost: float, now: float = now) -> None:
            if now + cost < best[end]:
                best[end] = now + cost

        offer(i + 1, brute[i])
        for end in range(i + 2, min(n, i + longest) + 1):
            if (place := rank.get(lower[i:end])) is not None:
                part = value[i:end]
                offer(end, math.log10(place + 1) + (0 if part == lower[i:end] else 0.31 if part == part.upper() or part == part.capitalize() else 1.0))
        if value[i].isdigit() and (m := DATE.match(value, i)):
            offer(m.end(), math.log10(365 * 200) if m.end() - i > 4 else math.log10(200))
        if walk[i] >= 4:
            offer(i + walk[i], math.log10(47) + 0.31 * (walk[i] - 1))
        if run[i] >= 3:
            offer(i + run[i], math.log10(62 * run[i]))
        for unit, times in again.get(i, ()):
            offer(i + unit * times, before[i + unit] - before[i] + math.log10(times))
    return best[n]


FIELDS = [C.field(n, k) for n, k in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string"), ("n_guess", "long"), ("guess_log10", "double"), ("found", C.structs(kind="string", start="long", end="long", guess_log10="double")))]


def spans_of(text: str, least_cost: float = 9.0, shortest: int = 8, rank: dict[str, int] | None = None) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, cost) of each secret, by start and then by kind."""
    out: list[tuple[int, int, str, float | None]] = []
    raw = text.encode().lower()
    if any(cue in raw for cue in CUES) and MAY_MATCH.search(raw):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                out.append((m.start(), m.end(), "assign", guess_cost(m[2], rank)))
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?")
            if len(value) >= shortest and (cost := guess_cost(value, rank)) >= least_cost:
                out.append((m.start(1), m.start(1) + len(value), "guess", cost))
    out += [(m.start(), m.end(), "access", None) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex", None) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scanner(least_cost: float, vocabulary: str | None = None) -> Callable[[str], tuple]:
    from hashlib import sha256

    rank = dictionary(vocabulary)

    def scan(text: str) -> tuple:
        spans = spans_of(text, least_cost, rank=rank)
        named = [(f"{kind}:{a}:{b}", kind) for a, b, kind, _ in spans]
        base = ",".join(s for s, kind in named if kind != "guess")
        kinds = [kind for _, kind in named]
        found = [{"kind": kind, "start": a, "end": b, "guess_log10": cost} for a, b, kind, cost in spans]
        return *(kinds.count(k) for k in KINDS[:3]), sha256(base.encode()).hexdigest(), ",".join(s for s, _ in named), kinds.count("guess"), max((s[3] for s in spans if s[3] is not None), default=None), found

    return scan


def secret_scan(docs: DataFrame, least_cost: float = 9.0, text_col: str = "text", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """Find secrets in each whole text; columns of `docs` with the new names are replaced.

    Adds n_assign, n_access and n_hex (matches of the fixed patterns), base_sha256 (of "kind:start:end" of these, by
    start and then kind, comma-joined), spans (all, joined likewise), n_guess (values in a credential context whose
    guess cost is 10^least_cost or more), guess_log10 (the largest cost of an assigned or guessed value; null if
    none) and found (all spans with their costs). Positions count code points and ends are exclusive. A null text
    is empty and holds none; repeated rows are scanned one by one; an empty table gives an empty one. `vocabulary` is
    the file of a public tokenizer whose whole words, by rank, join the dictionary. Texts and values may have any length.
    """
    return C.map_text(docs, lambda: scanner(least_cost, vocabulary), FIELDS, text_col, keep)


def redacted(docs: DataFrame, least_cost: float = 9.0, text_col: str = "text", mark: str = "[secret]", vocabulary: str | None = None) -> DataFrame:
    """docs with each secret's characters replaced by `mark` (overlapping spans by one); null texts stay null.

    Columns and their order stay, whatever their names; repeated rows are treated alike; empty in, empty out.
    """
    made_col = C.unused(docs, "redacted")

    def make() -> Callable[[str], tuple]:
        rank = dictionary(vocabulary)

        def cut(text: str) -> tuple:
            out, at = [], 0
            for a, b, _, _ in spans_of(text, least_cost, rank=rank):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return ("".join([*out, text[at:]]),)

        return cut

    made = C.map_text(docs, make, [C.field(made_col, "string")], text_col)
    text = F.when(C.quoted(text_col).isNotNull(), C.quoted(made_col)).alias(text_col)
    return made.select(*[text if c == text_col else C.quoted(c) for c in docs.columns])
