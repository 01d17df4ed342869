"""Personal data by a semi-Markov conditional random field.

Base spans come from fixed patterns and always stay.  The field adds what the
patterns cannot: addresses spelled out, numbers without a plus, cards and IPs
under other separators.  Its segments are whole candidate spans of at most
``MAX_TOKENS`` tokens around an anchor (digits, an at sign, a spelled "dot");
their features describe the span as a whole and what stands left and right of
it.  Dynamic programming over token positions chooses boundaries and kinds
jointly.  Outside candidates only one path exists (all tokens outside), so it
runs over islands of overlapping candidates and is exact for the whole text.

The weights are fitted by likelihood (forward-backward over segments) on
``TRAIN_TEXTS`` generated sentences, once per driver.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import spread, text_chunks

KINDS = ("email", "ip", "card", "phone")
TRAIN_TEXTS, EPOCHS, MAX_TOKENS, MAX_CHARS = 1200, 5, 20, 64

# The base patterns, rewritten so that no start is tried twice
_MAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
_MAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_ANCHOR = bytes(b for b in range(256) if b not in b"0123456789@")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns, leftmost and
    non-overlapping within a kind; matches that fail their test are dropped."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        m, start = _MAIL_RIGHT.match(text, at), at
        if m:
            while start > last and _MAIL_LEFT.match(text, start - 1):
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- candidate spans and their features -------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_SPELLED = re.compile(r"(?<![^\W_])dot(?![^\W_])|[\[({<]\s?at\s?[\])}>]", re.I)
_ANCHOR = re.compile(r"[0-9]{3}|[0-9][ .:-]{1,3}[0-9]|@|::|" + _SPELLED.pattern, re.I)
_NUMERIC = frozenset("+().-/ ")
# Words that announce a kind, or a number of no person
_CUES = {
    "mail": "email mail mails e-mail correo courriel contact write kontakt schreib escribe écris",
    "ip": "ip ipv4 ipv6 host server address client gateway dirección adresse login",
    "card": "card visa mastercard amex credit debit karte kreditkarte tarjeta carte bancaire",
    "phone": "phone tel telephone call mobile cell fax telefon handy teléfono móvil téléphone ruf llama appelle whatsapp",
    "other": "order invoice isbn version id no nr number rechnung ref ticket total sum year page section release "
             "pedido factura commande facture bestellung item lot part sku serial code pin zip",
}
_TAILS = frozenset("com org net edu gov info biz io co uk us eu de fr es it nl ch at".split())
_CUE = {w: k for k, ws in _CUES.items() for w in ws.split()}


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around anchors, wide enough for any candidate there and its context."""
    lo = hi = None
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - 2 * MAX_CHARS), m.end() + 2 * MAX_CHARS
        if hi is not None and a <= hi:
            hi = b
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def _spans(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """``(first token, behind the last, family)`` of every candidate."""
    words = [text[a:b] for a, b in tokens]
    n = len(words)
    glued = [i > 0 and tokens[i - 1][1] == tokens[i][0] for i in range(n)] + [False]
    for i, w in enumerate(words):
        start = tokens[i][0]
        # numbers: digits and a few signs; ends behind digits
        if (w.isascii() and w.isdigit()) or w in "+(":
            digits = 0
            for j in range(i, min(n, i + MAX_TOKENS)):
                x = words[j]
                if tokens[j][1] - start > MAX_CHARS or "\n" in text[tokens[j - 1][1] if j > i else start:tokens[j][0]]:
                    break
                if x.isascii() and x.isdigit():
                    digits += len(x)
                    if digits >= 7 or (digits >= 4 and j >= i + 6):
                        yield i, j + 1, "number"
                elif x not in _NUMERIC:
                    break
        # addresses of a network: hexadecimal groups between colons
        if len(w) <= 4 and w.isascii() and w.isalnum() and i + 2 < n and words[i + 1] == ":":
            j, colons = i, 0
            while j < min(n, i + MAX_TOKENS) and (j == i or glued[j]) and (
                    words[j] == ":" or (len(words[j]) <= 4 and words[j].isascii() and words[j].isalnum())):
                colons += words[j] == ":"
                j += 1
            if colons >= 3 and words[j - 1] != ":":
                yield i, j, "groups"
        # mail addresses: an at sign or its spelling, with something on both sides
        if w == "@" or w.lower() == "at":
            left, k = [], i - 1
            while k >= max(0, i - 8) and (words[k].isalnum() or words[k] in "._%+-[]()<>{}") \
                    and "\n" not in text[tokens[k][1]:tokens[k + 1][0]]:
                if words[k].isalnum() and words[k].lower() not in ("at", "dot"):
                    left.append(k)
                k -= 1
            right, k = [], i + 1
            while k < min(n, i + 12) and (words[k].isalnum() or words[k] in ".-[]()<>{}") \
                    and "\n" not in text[tokens[k - 1][1]:tokens[k][0]]:
                if words[k].isalnum() and words[k].lower() not in ("at", "dot"):
                    right.append(k)
                k += 1
            for a in left:
                for b in right:
                    if b - a < MAX_TOKENS and tokens[b][1] - tokens[a][0] <= MAX_CHARS:
                        yield a, b + 1, "mail"


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int, family: str) -> list[str]:
    """What is known of a whole span and its surroundings."""
    a, b = tokens[i][0], tokens[j - 1][1]
    span = text[a:b]
    before, after = text[a - 1:a], text[b:b + 1]
    out = [family, f"{family} before {_side(before)}", f"{family} after {_side(after)}"
           + (" digit" if text[b + 1:b + 2].isdigit() and after in ".,:/-" and after else "")]
    cues = {_CUE[w] for t in range(max(0, i - 5), i) if (w := text[tokens[t][0]:tokens[t][1]].lower()) in _CUE}
    out += [f"{family} cue {c}" for c in cues] or [f"{family} no cue"]
    if family == "number":
        groups = re.findall("[0-9]+", span)
        digits = "".join(groups)
        signs = "".join(sorted(set(span) - set("0123456789")))
        shape = "-".join(str(min(len(g), 9)) for g in groups[:7])
        out += [f"digits {min(len(digits), 20)}", f"shape {shape}", f"signs {signs}", f"shape {shape} signs {signs}",
                f"open {span[0] if not span[0].isdigit() else 'digit'}"]
        if 12 <= len(digits) <= 19:
            out.append(f"card length luhn {luhn(digits)} groups {min(4, len(groups))}")
        if len(groups) == 4 and max(map(len, groups)) <= 3:
            dots = re.fullmatch(r"[0-9]+( ?\. ?[0-9]+){3}", span) is not None
            out.append(f"four octets {octets(groups)} dots {dots}")
        if span.count("(") != span.count(")") or "((" in span or ".." in span or "--" in span:
            out.append("unbalanced")
        if "  " in span or re.search(r"[-.] [0-9]|[0-9] [-.](?! )", span):
            out.append("loose")
    elif family == "groups":
        groups = span.split(":")
        six = len(groups) <= 8 and all(re.fullmatch("[0-9A-Fa-f]{0,4}", g) for g in groups) \
            and (len(groups) == 8) == ("::" not in span) and span.count("::") < 2
        out += [f"groups {len(groups)}", f"six {six}", f"letters {bool(re.search('[a-fA-F]', span))}",
                f"long {sum(len(g) > 2 for g in groups) >= 2}"]
    else:
        flat = re.sub(r"\s*[\[({<]\s*|\s*[\])}>]\s*", " ", span.lower())
        bracket = re.search(r"[\[({<]\s*(?:at|@)\s*[\])}>]", span.lower()) is not None
        spelled = re.sub(r"\s+at\s+", "@", re.sub(r"\s+dot\s+", ".", flat))
        whole = re.fullmatch(r"[a-z0-9._%+-]+ ?@ ?[a-z0-9-]+( ?\. ?[a-z0-9-]+)+", spelled) is not None
        tail = re.split(r"[.\s]", spelled)[-1]
        out += [f"at sign {'@' in span} bracket {bracket}", f"whole {whole}", f"whole {whole} dots {'dot' in flat.split()}",
                f"whole {whole} at {'@' in span} bracket {bracket} dot {'dot' in flat.split()}",
                f"tail {tail.isalpha() and 2 <= len(tail) <= 6} known {tail in _TAILS}",
                f"sentence {re.search(r'[^ ][.] ', span) is not None} at {'@' in span} bracket {bracket}", f"spaces {min(4, flat.count(' '))}",
                f"longer {_longer(text, a, b)}"]
    return out


def _side(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "letter" if c.isalpha() else "digit" if c.isdigit() else c


def _longer(text: str, a: int, b: int) -> bool:
    """Whether an address would go on at either side."""
    return re.match(r"\s*(?:dot|[\[({<]\s*dot\s*[\])}>])\s|\.[^\W_]", text[b:b + 12], re.I) is not None \
        or re.search(r"(?:\sdot\s+|[\[({<]\s*dot\s*[\])}>]\s*|[._%+-])$", text[max(0, a - 12):a], re.I) is not None


# --- the field --------------------------------------------------------------------------


class Field:
    """Weights by feature and kind, and by neighbouring labels (0 is outside)."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves, m = weights, moves, moves
        # a span below this loses to tokens outside, whatever its neighbours are
        self.floor = np.array([(m[:, 0][:, None] + m[0][None, :] - m[:, y][:, None] - m[y][None, :]).min()
                               for y in range(1, len(m))])

    def score(self, features: list[str]) -> np.ndarray:
        got = [w for f in features if (w := self.weights.get(f)) is not None]
        return sum(got, np.zeros(len(KINDS)))

    def decode(self, first: int, behind: int, spans: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """Best segmentation of the tokens of an island: ``(first, behind, kind)``."""
        m, ends = self.moves, {}
        for i, j, s in spans:
            ends.setdefault(j, []).append((i, s))
        best = {first: (np.array([0.0] + [-np.inf] * len(KINDS)), [None] * (len(KINDS) + 1))}
        for j in range(first + 1, behind + 1):
            score, back = np.full(len(KINDS) + 1, -np.inf), [None] * (len(KINDS) + 1)
            for i, s in [(j - 1, None), *ends.get(j, [])]:
                came = best[i][0][:, None] + m
                frm = came.argmax(0)
                for y in ([0] if s is None else range(1, len(KINDS) + 1)):
                    v = came[frm[y], y] + (0 if s is None else s[y - 1])
                    if v > score[y]:
                        score[y], back[y] = v, (i, int(frm[y]))
            best[j] = (score, back)
        out, j = [], behind
        y = int((best[j][0] + m[:, 0]).argmax())
        while j > first:
            i, before = best[j][1][y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, before
        return out[::-1]


def _islands(spans: list) -> Iterator[tuple[int, int, list]]:
    """Maximal sets of candidates that overlap or touch."""
    part, end = [], None
    for s in sorted(spans, key=lambda s: s[:2]):
        if part and s[0] > end:
            yield part[0][0], end, part
            part = []
        end = s[1] if not part else max(end, s[1])
        part.append(s)
    if part:
        yield part[0][0], end, part


def field_spans(field: Field, text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the best segmentation of the whole text."""
    out = []
    for lo, hi in _windows(text):
        if lo and text[lo - 1].isalnum():  # start at a whole token
            lo = next((k for k in range(lo, min(hi, lo + MAX_CHARS)) if not text[k].isalnum()), lo)
        tokens = [m.span() for m in _TOKEN.finditer(text, lo, min(len(text), hi))]
        scored = ((i, j, field.score(_features(text, tokens, i, j, family)))
                  for i, j, family in _spans(text, tokens))
        found = [f for f in scored if (f[2] > field.floor).any()]
        for first, behind, spans in _islands(found):
            out += [(tokens[i][0], y, tokens[j - 1][1]) for i, j, y in field.decode(first, behind, spans)]
    return out


def _forward_backward(n: int, spans: list, moves: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Log partition, and the marginals of spans and of moves."""
    k = len(KINDS) + 1
    ends, starts = {}, {}
    for c, (i, j, s) in enumerate(spans):
        ends.setdefault(j, []).append((i, c, s))
        starts.setdefault(i, []).append((j, c, s))
    a = np.full((n + 1, k), -np.inf)
    a[0, 0] = 0
    log = np.logaddexp.reduce
    into = np.full((n + 1, k), -np.inf)  # mass at i, moved to the label of the next segment
    for j in range(n + 1):
        if j:
            a[j, 0] = into[j - 1, 0]
            for i, _, s in ends.get(j, []):
                a[j, 1:] = np.logaddexp(a[j, 1:], into[i, 1:] + s)
        into[j] = log(a[j][:, None] + moves, axis=0)
    b = np.full((n + 1, k), -np.inf)
    b[n] = moves[:, 0]
    z = float(log(a[n] + b[n]))
    out_of = np.full((n + 1, k), -np.inf)  # from i, by the label of the next segment
    marg = [np.zeros(k - 1) for _ in spans]
    pairs = np.exp(a[n] + b[n] - z)[:, None] * np.eye(k)[0]
    for i in range(n - 1, -1, -1):
        out_of[i, 0] = b[i + 1, 0]
        for j, c, s in starts.get(i, []):
            out_of[i, 1:] = np.logaddexp(out_of[i, 1:], s + b[j, 1:])
            marg[c] = np.exp(into[i, 1:] + s + b[j, 1:] - z)
        b[i] = log(moves + out_of[i], axis=1)
        pairs += np.exp(a[i][:, None] + moves + out_of[i] - z)
    return z, marg, pairs


def fit_field(texts: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.3,
              ridge: float = 1e-4) -> Field:
    """Maximum likelihood by AdaGrad; ``texts`` carry their ``(start, kind, end)`` spans."""
    names: dict[str, int] = {}
    cases = []
    for text, gold in texts:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        first, behind = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        spans = [(i, j, np.array([names.setdefault(f, len(names)) for f in _features(text, tokens, i, j, fam)]))
                 for i, j, fam in _spans(text, tokens)]
        want = {(first[a], behind[b]): y for a, y, b in gold}
        if want.keys() <= {s[:2] for s in spans}:
            cases.append((len(tokens), spans, want))
    k = len(KINDS) + 1
    w, moves = np.zeros((len(names), k - 1)), np.zeros((k, k))
    gw, gm = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    rng = random.Random(11)
    for _ in range(epochs):
        for n, spans, want in rng.sample(cases, len(cases)):
            _, marg, pairs = _forward_backward(n, [(i, j, w[f].sum(0)) for i, j, f in spans], moves)
            for (i, j, f), p in zip(spans, marg):
                step = p.copy()
                if (i, j) in want:
                    step[want[i, j]] -= 1
                if np.abs(step).max() > 1e-4:
                    step = step + ridge * w[f]
                    gw[f] += step ** 2
                    w[f] -= rate * step / np.sqrt(gw[f])
            at, y, step = 0, 0, pairs
            while at <= n:
                nxt = next(((b, t + 1) for (a, b), t in want.items() if a == at), (at + 1, 0))
                step[y, nxt[1]] -= 1
                at, y = nxt
            step[0, 0] = 0  # outside to outside stays 0: tokens outside islands add nothing
            gm += step ** 2
            moves -= rate * step / np.sqrt(gm)
    return Field({f: w[i] for f, i in names.items() if np.abs(w[i]).max() > 1e-3}, moves)


# --- generated sentences ------------------------------------------------------------------


def _some(rng: random.Random, k: int, letters: str = "0123456789") -> str:
    return "".join(rng.choices(letters, k=k))


def _word(rng: random.Random) -> str:
    w = "".join(rng.choice("b c d f g l m n p r s t v st".split()) + rng.choice("a e i o u é ü".split())
                for _ in range(rng.randint(1, 4)))
    return rng.choice([w, w, w, w.title(), w + rng.choice(",.;:!")])


def _card_number(rng: random.Random, good: bool = True) -> str:
    n = rng.choice([15, 16, 16, 16, 16])
    head = rng.choice("3456") + _some(rng, n - 2)
    last = next(d for d in "0123456789" if luhn(head + d))
    return head + (last if good else str((int(last) + rng.randint(1, 9)) % 10))


def _grouped(d: str, sign: str) -> str:
    return sign.join([d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i:i + 4] for i in range(0, len(d), 4)])


def _personal(rng: random.Random, kind: int) -> tuple[str, bool]:
    """An example of a kind, and whether only its surroundings tell what it is."""
    if kind == 0:
        plain = lambda: _word(rng).strip(",.;:!").lower().replace("é", "e").replace("ü", "u")
        name = [plain() + rng.choice(["", "", _some(rng, 2)]) for _ in range(rng.randint(1, 2))]
        host = [plain() + rng.choice(["", "", _some(rng, 1)]) for _ in range(rng.randint(1, 2))]
        host.append(rng.choice("com org net de fr es info".split()))
        at, dot = rng.choice([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", "."),
                              (" (at) ", " (dot) "), (" AT ", " DOT "), (" @ ", " . "), (" [at] ", "."), ("{at}", "{dot}")])
        return (dot if "dot" in dot.lower() else ".").join(name) + at + dot.join(host), False
    if kind == 1:
        if rng.random() < 0.35:
            groups = [format(rng.randrange(65536), "x") for _ in range(8)]
            return ":".join(groups), False
        sign = rng.choice([".", ".", ".", " . ", ". "])
        return sign.join(str(rng.randrange(256)) for _ in range(4)), sign != "."
    if kind == 2:
        return _grouped(_card_number(rng), rng.choice(["", " ", "-", ".", ". ", "/", " - "])), False
    a, b, c = _some(rng, 3, "23456789"), _some(rng, 3, "23456789"), _some(rng, 4)
    form = rng.randrange(8)
    if form == 7:
        return f"0{_some(rng, 2, '123456789')}{rng.choice([' ', '/', '-'])}{_some(rng, rng.choice([7, 8]))}", True
    return [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{_some(rng, 2, '3456')} {a} {b}{c}",
            f"+1{a}{b}{c}", f"1-{a}-{b}-{c}"][form], form in (2, 3)


def _other(rng: random.Random) -> str:
    """Numbers and phrases of no person."""
    hexes = _some(rng, rng.choice([8, 16, 32, 40]), "0123456789abcdef")
    return rng.choice([
        lambda: _some(rng, rng.randint(1, 22)), lambda: hexes, lambda: f"20{_some(rng, 2)}-0{_some(rng, 1, '123456789')}-1{_some(rng, 1)}",
        lambda: f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}", lambda: f"v{_some(rng, 1)}.{_some(rng, 2)}.{_some(rng, 1)}",
        lambda: f"{_some(rng, 3)},{_some(rng, 3)}.{_some(rng, 2)}", lambda: f"{_some(rng, 4)}.{_some(rng, 3)}.{_some(rng, 4)}.{_some(rng, 3)}",
        lambda: _grouped(_card_number(rng, False), rng.choice(["", "", " ", "-"])), lambda: f"978-{_some(rng, 1)}-{_some(rng, 4)}-{_some(rng, 4)}-{_some(rng, 1)}",
        lambda: " ".join(_some(rng, rng.randint(1, 4)) for _ in range(rng.randint(2, 9))), lambda: f'token = "{hexes}"',
        lambda: " ".join(map(str, range(k := rng.randrange(1, 90), k + rng.randrange(5, 18)))),
        lambda: ", ".join(_some(rng, 3) for _ in range(4)), lambda: f"{_word(rng)} at {_word(rng)}", lambda: f"{_word(rng)} @ {_word(rng)}",
        lambda: f"look at the dot {_word(rng)}", lambda: f"{_word(rng)} at {_word(rng)}. {_word(rng).title()}",
        lambda: f"{_word(rng)}. At {_word(rng)}. {_word(rng).title()}", lambda: f"at {_word(rng)} dot {_word(rng)}", lambda: f"@{_word(rng)}", lambda: f"{_some(rng, 3)}/{_some(rng, 4)}/{_some(rng, 2)}",
        lambda: f"{_some(rng, 2)}:{_some(rng, 2)}:{_some(rng, 2)}:{_some(rng, 2)}", lambda: f"{_some(rng, 3)}-{_some(rng, 3)}-{_some(rng, 5)}",
        lambda: f"{_some(rng, 7)}-{_some(rng, 7)}", lambda: f"({_some(rng, 4)}) {_some(rng, 5)}"])()


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and its personal data as ``(start, kind number, end)``."""
    parts, gold, at = [], [], 0

    def add(s: str) -> None:
        nonlocal at
        parts.append(s)
        at += len(s)

    cue = [_CUES[k].split() for k in ("mail", "ip", "card", "phone")]
    for _ in range(rng.randint(1, 3)):
        for _ in range(rng.randint(2, 6)):
            add(_word(rng) + " ")
        if rng.random() < 0.55:
            kind = rng.randrange(4)
            s, needs = _personal(rng, kind)
            if needs or rng.random() < 0.4:
                add(rng.choice(cue[kind]) + rng.choice([" ", ": ", " - "]))
            gold.append((at, kind, at + len(s)))
            add(s)
        else:
            if rng.random() < 0.4:
                add(rng.choice(_CUES["other"].split()) + rng.choice([" ", ": ", " #"]))
            add(_other(rng))
        add(rng.choice([" ", " ", ", ", ". ", "\n"]))
    for _ in range(rng.randint(0, 4)):
        add(_word(rng) + " ")
    return "".join(parts), gold


@functools.cache
def trained_field(texts: int = TRAIN_TEXTS, seed: int = 7) -> Field:
    rng = random.Random(seed)
    return fit_field([example(rng) for _ in range(texts)])


# --- documents -----------------------------------------------------------------------------


def personal_spans(field: Field, text: str) -> list[tuple[int, int, int, bool]]:
    """``(start, kind number, end, base)``: base spans, and those of the field
    that overlap none of them."""
    if not text.encode("utf-8", "surrogatepass").translate(None, _NO_ANCHOR) and not _SPELLED.search(text):
        return []
    base = base_spans(text)
    taken = sorted((a, b) for a, _, b in base)
    out, t = [(*s, True) for s in base], 0
    for a, y, b in field_spans(field, text):  # in order, as the base spans are
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        if t == len(taken) or taken[t][0] >= b:
            out.append((a, y, b, False))
    return sorted(out)


def _found(field: Field):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in text_chunks(batches):
            spans = [[{"kind": KINDS[y], "start": a, "end": b, "base": base}
                      for a, y, b, base in personal_spans(field, t or "")] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "spans": spans})
    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       field: Field | None = None) -> DataFrame:
    """``(doc_id, spans)``: personal data of every whole text, as an array of
    ``kind, start, end, base`` in code points, ordered by start, then kind.

    ``base`` tells the fixed patterns from what the field adds.  A null text is
    empty, a null id stays null, repeated rows are answered each, an empty table
    gives no rows, other columns are ignored.
    """
    src = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return src.mapInPandas(_found(field or trained_field()),
                           "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for a, y, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[y]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
