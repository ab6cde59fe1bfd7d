"""Personal data: validated patterns, and candidates chosen by boosted trees; DataFrame functions only.

Four base kinds are found by pattern over the whole text and validated. Then loose
generators propose further spans in what the base kinds left: obfuscated addresses,
values behind a key word (quoted or not), names of accounts, keys by their prefix and
long random strings, account numbers with a country, digit groups and the known forms
among these groups. Proposals overlap, also across kinds. Gradient boosted trees, one
set a kind, score each proposal by its format and by the words before it; a proposal
counts if its score reaches the threshold of its kind, which is the lowest of even odds
or more that keeps PRECISION on held-out labelled rows, and of overlapping ones the best score is taken
(then the longer, then the first, then the kind's name). The trees are fitted on
LABELLED_ROWS rows made by a seeded rule (a documented bound; no corpus text is used),
and run as a nested CASE.

Null and empty texts have no spans. Texts may be of any length: places of n matches are
summed up in blocks of sqrt(n), and overlaps are settled inside groups of proposals that
touch. Rows that repeat get equal results; extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import let

#: The base kinds in order. Possessive forms and look-behinds of the given patterns, equal in what they match and linear in time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

WORDS_OF_SECRETS = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|api[_-]?key|key)"
#: Known beginnings of keys that services hand out.
PREFIXES = r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|[spr]k[-_](?:live[-_]|test[-_])?|xox[abprs]-|npm_|hf_|SG\.|eyJ)"
#: A dash or dot that joins a number to more digits makes it a part of another number.
APART, ENDS = r"(?<![0-9A-Za-z])(?<![0-9][.-])", r"(?![0-9A-Za-z]|[.-][0-9])"
FORMS = (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}", r"[0-9]{7,22}+")
#: Loose generators: kind, patterns, what a text must have for the patterns to be tried.
GENERATORS = (
    ("mail", (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\]|\.|\x20dot\x20)\x20?[A-Za-z]{2,}+",), r"[(\[\x20]at[)\]\x20]"),
    ("secret", (rf"(?<![A-Za-z]){WORDS_OF_SECRETS}[\"']?\x20{{0,2}}(?:=>|[=:])\x20{{0,2}}[\"']?[^\s\"'`,;<>\x01]{{4,200}}+[\"']?",), r"[=:]"),
    ("account", (r"(?<![A-Za-z])(?i:user(?:[_-]?name|[_-]?id)?|login|account|acct|handle)[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?[A-Za-z0-9][A-Za-z0-9._-]{2,39}+[\"']?",), r"[=:]"),
    ("key", (rf"(?<![A-Za-z0-9_]){PREFIXES}[A-Za-z0-9_./+-]{{10,200}}+=*+", r"(?<![A-Za-z0-9_/+.-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{20,200}+={0,2}+(?![A-Za-z0-9])"), r"[A-Za-z0-9_./+-]{14}"),
    ("iban", (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",), r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    ("number", (r"(?<![0-9A-Za-z])(?<![0-9][\x20.()-])[0-9](?:[\x20.()-]?[0-9]){6,21}+(?![\x20.()-]?[0-9])", *(f"{APART}{form}{ENDS}" for form in FORMS)), r"[0-9](?:[\x20.()-]{0,2}[0-9]){6}"),
)
BEFORE = 24
GOOD_CONTEXT = r"(?i:call|phone|tel|mobile|cell|contact|fax|ssn|social|account|acct|iban|passport|mail|write to|reach|number is|key|token|secret|credential|bearer)[^\n]{0,12}$"
BAD_CONTEXT = r"(?i:order|invoice|isbn|issn|page|version|vol|no|nr|ref|item|part|serial|population|year|total|price|commit|sha[0-9]*|md5|hash|checksum|digest|uuid|build)[.:#=\x20]{0,3}$"
PLACEHOLDER = r"(?i:^(?:null|none|nil|true|false|undefined|unknown|required|optional|string|value|example|changeme|redacted|hidden|x{3,}|\*{3,}|\.{3,}|-{3,}|your.*|my.*|some.*|\$.*|\{.*|%.*|\[.*|\(.*)$)"
LABELLED_ROWS = 6000
ROUNDS, SHRINK, PRECISION, SEED = 24, 0.4, 0.98, 7

KINDS = (*BASE_KINDS, *(g[0] for g in GENERATORS))


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of a non-empty array: inside blocks of sqrt(n), then over the blocks, so no array grows to n by single steps."""

    def inside(block: Column) -> Column:
        def step(out: Column, x: Column) -> Column:
            return F.concat(out, F.array(F.when(F.size(out) == 0, x).otherwise(combine(F.element_at(out, -1), x))))

        return F.aggregate(block, F.array().cast("array<int>"), step)

    def over(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / width).cast("int")), lambda b: inside(F.slice(values, b * width + 1, width)))

        def whole(own: Column) -> Column:
            return let(inside(F.transform(own, lambda b: F.element_at(b, -1))), lambda tops: F.flatten(F.transform(own, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: combine(F.get(tops, i - 1), x))))))

        return let(blocks, whole)

    return let(F.ceil(F.sqrt(F.size(values))).cast("int"), over)


def spans(text: Column, pattern: str, behind: bool = False) -> Column:
    """Start, end and text of each match, in code points: lengths of matches and of what stands between, accumulated. behind adds up to BEFORE characters before it, from the match before on."""

    def of(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        steps = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))
        ends = let(steps, lambda x: scan(x, lambda a, b: a + b))
        found = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))
        if not behind:
            return found
        last = lambda g, i: F.substring(F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), g), -BEFORE, BEFORE)
        return F.zip_with(found, let(gaps, lambda x: F.transform(x, last)), lambda x, w: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), w.alias("b")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none(behind)).otherwise(of(m)))


def none(behind: bool = False) -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string" + ",b:string" * behind + ">>")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    def doubled(d: Column) -> Column:
        return F.when(d > 4, d * 2 - 9).otherwise(d * 2)

    def value(number: Column) -> Column:
        at = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, i: total + F.when(i % 2 == 1, at(i)).otherwise(doubled(at(i))))

    return let(digits(text), value) % 10 == 0


def remainder(text: Column) -> Column:
    """What the check digits of an account number with a country leave of it by 97."""

    def of(bare: Column) -> Column:
        def step(total: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code < 65, total * 10 + code - 48).otherwise(total * 100 + code - 55) % 97

        return F.aggregate(F.split(F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4)), ""), F.lit(0), lambda t, c: F.when(c == "", t).otherwise(step(t, c)))

    return let(F.regexp_replace(text, r"\x20", ""), of)


def base_spans(text: Column) -> dict[str, Column]:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
    n = lambda x: F.length(digits(x["m"]))
    tried = {
        "email": (text.contains("@"), EMAIL, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: x["m"].rlike(rf"^{part}(?:\.{part}){{3}}$")),
        "card": (text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), CARD, lambda x: F.when(n(x).between(16, 19), luhn(x["m"])).otherwise(F.lit(False))),
        "phone": (text.contains("+"), PHONE, lambda x: n(x).between(8, 15)),
    }
    return {k: F.when(guard, spans(text, pattern) if valid is None else F.filter(spans(text, pattern), valid)).otherwise(none()) for k, (guard, pattern, valid) in tried.items()}


def overwritten(text: Column, found: Column, mark: Callable[[Column], Column]) -> Column:
    """text with what sorted spans (s, e and more) cover replaced by mark(s, e of what is still uncovered, v the span, apart if it begins behind all before it)."""

    def of(reach: Column) -> Column:
        at = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
        gaps = F.transform(found, lambda v, i: F.struct(at(i).alias("a"), F.greatest(v["s"], at(i)).alias("z"), F.get(reach, i).alias("e"), (v["s"] >= at(i)).alias("apart"), v.alias("v")))
        rest = F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
        return F.concat(let(gaps, lambda g: pieces(text, g, mark)), rest)

    return F.when(F.size(found) == 0, text).otherwise(let(let(F.transform(found, lambda v: v["e"]), lambda ends: scan(ends, F.greatest)), of))


def blanked(text: Column, found: Column) -> Column:
    """text with the spans overwritten by as many control characters, so places stay."""
    return overwritten(text, found, lambda g: F.repeat(F.lit("\x01"), g["e"] - g["z"]))


def pieces(text: Column, gaps: Column, mark: Callable[[Column], Column]) -> Column:
    """The pieces text[a:z] of sorted gaps joined, mark(gap) behind each. Pieces are cut from blocks of the text, since a substring counts from the text's begin."""

    def block(width: Column) -> Column:
        n = ((F.size(gaps) - 1) / width).cast("int")

        def of(b: Column) -> Column:
            own = F.slice(gaps, b * width + 1, width)

            def inside(g: Column) -> Column:
                first = F.element_at(g, 1)["a"]
                part = F.substring(text, first + 1, F.element_at(g, -1)["z"] - first)
                return let(part, lambda p: F.array_join(F.transform(g, lambda x: F.concat(F.substring(p, x["a"] - first + 1, x["z"] - x["a"]), mark(x))), ""))

            return let(own, inside)

        return F.array_join(F.transform(F.sequence(F.lit(0), n), of), "")

    return let(F.ceil(F.sqrt(F.size(gaps))).cast("int"), block)


FEATURES = ("digits", "lower", "upper", "length", "signs", "distinct", "changes", "good", "bad", "form", "equals", "quoted", "placeholder")


def value_of(kind: str, m: Column) -> Column:
    """What stands behind the key word, without quotes; the whole match of other kinds."""
    return F.regexp_replace(F.regexp_replace(m, r"^[^=:]*(?:=>|[=:])[\x20\"']*", ""), r"[\"']$", "") if kind in ("secret", "account") else m


def form_of(kind: str, m: Column, v: Column) -> Column:
    if kind == "mail":
        return F.when(m.rlike(r"[(\[](?:at|dot)[)\]]|\x20dot\x20"), 2).when(m.rlike(r"(?i:\.(?:com|org|net|edu|gov|io))$"), 1).otherwise(0)
    if kind == "secret":
        return m.rlike(r"^(?i:pass|pwd|secret)").cast("int")
    if kind == "key":
        return F.when(v.rlike(f"^{PREFIXES}"), 2).when(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 1).otherwise(0)
    if kind == "iban":
        return (remainder(m) == 1).cast("int")
    if kind == "number":
        return F.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 4).when(m.rlike(r"^(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}$"), 3).when(m.rlike(r"^[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), 2).when(m.rlike("^[0-9]+$"), 1).otherwise(0)
    return F.lit(0)


def features(kind: str, m: Column, before: Column) -> Column:
    """Format and context of a proposal, as an array of doubles."""

    def of(v: Column) -> Column:
        n = lambda drop: F.length(F.regexp_replace(v, drop, ""))
        f = {
            "digits": n("[^0-9]"),
            "lower": n("[^a-z]"),
            "upper": n("[^A-Z]"),
            "length": F.length(v),
            "signs": n("[0-9A-Za-z]"),
            "distinct": F.size(F.array_distinct(F.split(v, ""))),
            "changes": F.length(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[A-Za-z]+", "a")),
            "good": before.rlike(GOOD_CONTEXT).cast("int"),
            "bad": before.rlike(BAD_CONTEXT).cast("int"),
            "form": form_of(kind, m, v),
            "equals": m.contains("=").cast("int"),
            "quoted": m.rlike("[\"']").cast("int"),
            "placeholder": v.rlike(PLACEHOLDER).cast("int"),
        }
        return F.array(*[f[k].cast("double") for k in FEATURES])

    return let(value_of(kind, m), of)


def labelled(n: int = LABELLED_ROWS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """Kind, words before, proposal and whether it is personal: examples made by rule, as many of each kind. Spacing, quotes and case are drawn apart from the label."""
    r = random.Random(seed)
    some = lambda letters, a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    num = lambda k: some("0123456789", k, k)
    lower, upper, figures = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: some("abcdefghilmnoprstu", 3, 8)
    plain = lambda: r.choice((f"{word()} {word()} ", f"{word()}. ", "", f"{word()}, ", f"{word()}### "))
    good = lambda: r.choice(("call me at ", "phone: ", "tel ", "contact ", "mobile ", "fax: ", "SSN ", "my account is ", "my number is ", "reach us at "))
    bad = lambda: r.choice(("order no ", "invoice ", "ISBN ", "version ", "page ", "ref: ", "item ", "serial ", "total "))

    def assigned(names: tuple[str, ...], value: str) -> str:
        name = r.choice(names)
        name = r.choice((name, name, name.upper(), name.title()))
        quote = r.choice(("", "", "'", '"'))
        after = r.choice(("", quote))
        return f"{name}{after if quote else ''}{r.choice(('=', ':', ' = ', ': ', ' : ', '= ', ' =>', ' => ')) if names is secrets else r.choice(('=', ':', ' = ', ': '))}{quote}{value}{quote}"

    secrets = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "api-key", "apikey", "key", "auth", "credential")
    accounts = ("user", "username", "user_name", "user-id", "login", "account", "acct", "handle")

    def mail() -> tuple[str, str, int]:
        host, end = word(), r.choice(("com", "org", "net", "edu", "io"))
        name = r.choice((word(), f"{word()}.{word()}", f"{word()}{num(2)}"))
        if r.random() < 0.55:
            return plain(), r.choice((f"{name} (at) {host} (dot) {end}", f"{name}(at){host}.{end}", f"{name} [at] {host} [dot] {end}", f"{name} at {host} dot {end}", f"{name}[at]{host}.{end}", f"{name} at {host}.{end}")), 1
        return plain(), r.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()}. {word()}", f"{word()} at {word()}. {word().title()}")), 0

    def secret() -> tuple[str, str, int]:
        if r.random() < 0.55:
            value = r.choice((some("0123456789abcdef", 10, 64), some(lower + upper + figures, 8, 40), word() + num(r.randint(1, 4)) + r.choice(("", word())), some(lower, 9, 20), some(lower + upper + figures + "!#$%&*+-?@^_", 8, 24) + num(1), num(1) + some(lower + figures, 9, 30)))
            if value.isalpha() and value.islower():
                return plain(), r.choice(("password", "passwd", "pwd", "passphrase", "secret")) + r.choice(("=", "='", ' = "', ': "', "=")) + value, 1
            return plain(), assigned(secrets, value), 1
        value = r.choice((word(), word(), some(lower, 4, 8), some(lower, 4, 8) + r.choice((".", "!", "?")), "null", "none", "true", "false", "required", "string", "changeme", "xxxxxxxx", "********", "${SECRET}", "your_password", "{{token}}", "[hidden]", "%s%s"))
        return plain(), assigned(secrets, value) if not value.islower() or r.random() < 0.3 else r.choice(secrets) + r.choice((": ", " : ")) + value, 0

    def account() -> tuple[str, str, int]:
        if r.random() < 0.5:
            return plain(), assigned(accounts, r.choice((f"{word()}{num(r.randint(2, 4))}", f"{word()}_{word()}", f"{word()}.{word()}{r.choice(('', num(2)))}", num(r.randint(6, 12)), f"{word()}-{num(3)}"))), 1
        return plain(), assigned(accounts, r.choice((word(), word() + ".", "null", "none", "true", "string", "required", "unknown", word().title()))), 0

    def key() -> tuple[str, str, int]:
        c = r.random()
        if c < 0.3:
            return plain(), r.choice(("AKIA" + some(upper + "234567", 16, 16), "ASIA" + some(upper + "234567", 16, 16), "AIza" + some(lower + upper + figures + "_-", 35, 35), "ghp_" + some(lower + upper + figures, 36, 36), "glpat-" + some(lower + upper + figures, 20, 20), "sk_live_" + some(lower + upper + figures, 24, 24), "sk-" + some(lower + upper + figures, 32, 48), "xoxb-" + num(11) + "-" + some(lower + upper + figures, 24, 24), "hf_" + some(lower + upper + figures, 34, 34), "eyJ" + some(lower + upper + figures, 20, 40) + "." + some(lower + upper + figures, 20, 40) + "." + some(lower + upper + figures, 20, 40))), 1
        if c < 0.4:
            return plain(), some(lower + upper, 9, 20) + num(2) + some(lower + upper + figures, 12, 30) + r.choice(("", "=", "==")), 1
        if c < 0.5:
            return r.choice(("bearer ", "secret key ", "my token ", "credentials ")), some("0123456789abcdef", 32, 64), 1
        if c < 0.6:
            return r.choice(("commit ", "sha256: ", "md5=", "checksum ", "uuid ", "hash: ")), r.choice((some("0123456789abcdef", 32, 64), "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)))), 0
        if c < 0.75:
            return plain(), some("0123456789abcdef", 24, 64), 0
        return plain(), r.choice(("-".join(word() for _ in range(5)) + "-" + num(r.randint(1, 4)), "/".join(word() for _ in range(5)) + num(r.randint(1, 2)), "_".join(word() for _ in range(4)) + "_v" + num(1) + "_" + word(), "sk-" + "-".join(word() for _ in range(3)), some(lower, 20, 30) + num(1), some(lower, 12, 24) + "-" + num(4) + "-" + word())), 0

    def iban() -> tuple[str, str, int]:
        country, body = some(upper, 2, 2), r.choice((some(figures, 12, 26), some(upper, 4, 4) + some(figures, 10, 18)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        y = int(r.random() < 0.5)
        if not y:
            check = (check + r.randint(1, 90)) % 97
        text = f"{country}{check:02d}{body}"
        if r.random() < 0.5:
            text = " ".join(text[i : i + 4] for i in range(0, len(text), 4))
        return r.choice((plain(), good())), text, y

    def number() -> tuple[str, str, int]:
        tel = lambda marks: f"{num(3)}{(a := r.choice(marks))}{num(3)}{r.choice((a, a, r.choice(marks)))}{num(4)}"
        c = r.randint(0, 9)
        if c == 0:
            return good(), tel("-. "), 1
        if c == 1:
            return r.choice((good(), plain())), r.choice((tel("-."), f"({num(3)}) {num(3)}-{num(4)}")), 1
        if c in (2, 3):
            return r.choice((good(), plain())), f"{num(3)}-{num(2)}-{num(4)}", 1
        if c == 4:
            return good(), num(r.randint(9, 12)), 1
        if c == 5:
            return bad(), r.choice((tel("-. "), f"{num(3)}-{num(2)}-{num(4)}")), 0
        if c == 6:
            return r.choice((bad(), plain())), num(r.randint(7, 22)), 0
        if c == 7:
            return plain(), " ".join(num(r.randint(1, 4)) for _ in range(r.randint(5, 7))), 0
        if c == 8:
            return plain(), r.choice((f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(1)}.{num(2)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(4)}")), 0
        return plain(), r.choice((f"{num(4)} {num(4)} {num(4)} {num(4)}", f"{num(1)} {num(3)} {num(3)} {num(3)}", f"{num(4)}-{num(4)}", f"{num(2)}-{num(5)}-{num(3)}")), 0

    makers = {"mail": mail, "secret": secret, "account": account, "key": key, "iban": iban, "number": number}
    return [(kind, *makers[kind]()) for i in range(n) for kind in (GENERATORS[i % len(GENERATORS)][0],)]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> list:
    """Depth-two trees (feature, threshold, low, high), low and high being trees or values, by Newton steps on the logistic loss."""
    score = np.zeros(len(y))
    trees = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        best, whole = (1e-9, None), g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for k in range(x.shape[1]) if depth else ():
            order = rows[x[rows, k].argsort(kind="stable")]
            value = x[order, k]
            cut = np.flatnonzero(value[1:] > value[:-1])
            if not len(cut):
                continue
            gs, hs = g[order].cumsum(), h[order].cumsum()
            more = gs[cut] ** 2 / (hs[cut] + 1.0) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1.0) - whole
            i = int(more.argmax())
            if more[i] > best[0] + 1e-12:
                best = (float(more[i]), (k, float(value[cut[i]] + value[cut[i] + 1]) / 2))
        if best[1] is None:
            return float(SHRINK * g[rows].sum() / (h[rows].sum() + 1.0))
        k, at = best[1]
        return k, at, grow(rows[x[rows, k] <= at], g, h, depth - 1), grow(rows[x[rows, k] > at], g, h, depth - 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), 2))
        score += [predict(trees[-1], row) for row in x]
    return trees


def predict(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def threshold(scores: list[float], y: list[int]) -> float:
    """The lowest score, of even odds at least, from which on held-out rows are personal with PRECISION; none is infinite."""
    own = sorted(zip(scores, y), reverse=True)
    best, hits = math.inf, 0
    for i, (s, right) in enumerate(own):
        hits += right
        if (i + 1 == len(own) or own[i + 1][0] < s) and hits >= PRECISION * (i + 1):
            best = s
    return max(best, 0.0)


def featured(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> list[tuple[str, tuple[float, ...], int]]:
    """Kind, features and label of labelled rows, in their order."""
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, kind string, before string, m string, y int")
    values = F.lit(None).cast("array<double>")
    for kind, _, _ in GENERATORS:
        values = F.when(F.col("kind") == kind, features(kind, F.col("m"), F.col("before"))).otherwise(values)
    return [(r["kind"], tuple(r["x"]), r["y"]) for r in sorted(table.select("i", "kind", "y", values.alias("x")).collect())]


@lru_cache(maxsize=1)
def model(spark: SparkSession) -> dict[str, tuple[list, float]]:
    """Trees and threshold of each kind: even rows fit, odd rows calibrate."""
    found, rows = {}, featured(spark, labelled())
    for kind, _, _ in GENERATORS:
        own = [r for r in rows if r[0] == kind]
        trees = fit(np.array([r[1] for r in own[::2]]), np.array([r[2] for r in own[::2]], float))
        found[kind] = trees, threshold([sum(predict(t, x) for t in trees) for _, x, _ in own[1::2]], [y for _, _, y in own[1::2]])
    return found


def tree_sql(tree, x: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] <= tree[1], tree_sql(tree[2], x)).otherwise(tree_sql(tree[3], x))


RATED = "array<struct<s:int,e:int,o:double,l:int,k:string,m:string>>"


def rated(text: Column, kind: str, patterns: tuple[str, ...], need: str, trees: list, limit: float) -> Column:
    """Proposals of a kind whose score reaches the limit: span, score and length (both negative), kind and text."""
    if limit == math.inf:
        return F.array().cast(RATED)

    def scored(x: Column) -> Column:
        def of(values: Column) -> Column:
            f = [F.get(values, F.lit(i)) for i in range(len(FEATURES))]
            score = sum((tree_sql(t, f) for t in trees), F.lit(0.0))
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), (-score).alias("o"), (x["s"] - x["e"]).alias("l"), F.lit(kind).alias("k"), x["m"].alias("m"))

        return let(features(kind, x["m"], x["b"]), of)

    proposed = F.concat(*[spans(text, p, True) for p in patterns])
    return F.when(text.rlike(need), F.filter(F.transform(proposed, scored), lambda x: x["o"] <= 1e-9 - limit).cast(RATED)).otherwise(F.array().cast(RATED))


def winners(proposals: Column) -> Column:
    """Of overlapping proposals the best, settled inside groups of proposals that touch."""

    def best(group: Column) -> Column:
        ordered = F.array_sort(F.transform(group, lambda x: F.struct(x["o"].alias("o"), x["l"].alias("l"), x["s"].alias("s"), x["k"].alias("k"), x.alias("x"))))

        def step(won: Column, y: Column) -> Column:
            return F.when(F.exists(won, lambda w: (w["s"] < y["x"]["e"]) & (y["x"]["s"] < w["e"])), won).otherwise(F.concat(won, F.array(y["x"])))

        return F.aggregate(ordered, F.array().cast(RATED), step)

    def grouped(x: Column) -> Column:
        def of(reach: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["s"] >= F.get(reach, i - 1)))
            return let(heads, lambda h: F.flatten(F.transform(h, lambda a, j: best(F.slice(x, a + 1, F.coalesce(F.get(h, j + 1), F.size(x)) - a)))))

        return let(let(F.transform(x, lambda y: y["e"]), lambda ends: scan(ends, F.greatest)), of)

    return F.when(F.size(proposals) < 2, proposals).otherwise(let(F.array_sort(proposals), grouped))


def told(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, and the spans by kind (arrays of start, end, text) of every document."""
    chosen = model(docs.sparkSession)
    x = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    x = x.withColumns({f"__{k}": v for k, v in base_spans(F.col("__text")).items()})
    x = x.withColumn("__base", F.array_sort(F.concat(*[F.transform(f"__{k}", lambda v: F.struct(v["s"].alias("s"), v["e"].alias("e"))) for k in BASE_KINDS])))
    x = x.withColumn("__blank", blanked(F.col("__text"), F.col("__base")))
    proposed = [rated(F.col("__blank"), kind, patterns, need, *chosen[kind]) for kind, patterns, need in GENERATORS]
    x = x.withColumn("__proposed", F.concat(*proposed)).withColumn("__won", winners(F.col("__proposed")))
    for kind, _, _ in GENERATORS:
        own = F.filter("__won", lambda v: v["k"] == kind)
        x = x.withColumn(f"__{kind}", F.array_sort(F.transform(own, lambda v: F.struct(v["s"].alias("s"), v["e"].alias("e"), v["m"].alias("m")))))
    return x.select(*keep, *[F.col(f"__{k}").alias(k) for k in KINDS])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and the hash of the base spans, all spans as text, and the number of all spans and of those of each added kind."""
    x = find(docs)
    base = F.flatten(F.array(*[told(k, F.col(k)) for k in BASE_KINDS]))
    every = F.concat(base, *[told(g[0], F.col(g[0])) for g in GENERATORS])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    added = [F.size(g[0]).cast("long").alias(f"n_{g[0]}") for g in GENERATORS]
    n_spans = sum((F.size(k).cast("long") for k in KINDS), F.lit(0).cast("long")).alias("n_spans")
    return x.select("doc_id", *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"), n_spans, *added)


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every found span replaced by its kind in brackets; of overlapping spans the first one's kind stands for all. A null text stays null."""
    x = find(docs, ("doc_id", "text"))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda v: F.struct(v["s"].alias("s"), v["e"].alias("e"), F.lit(kind).alias("k")))

    every = F.array_sort(F.concat(*map(named, KINDS)))
    return x.select("doc_id", let(every, lambda v: overwritten(F.col("text"), v, lambda g: F.when(g["apart"], F.concat(F.lit("["), g["v"]["k"], F.lit("]"))).otherwise(""))).alias("text"))
