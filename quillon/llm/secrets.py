"""Secret scans by assignment-aware lexing: name-literal pairs, propagated constants, scores by target names."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base kinds, in their order. The flags keep case folding to ASCII letters.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}", re.A)  # a shorter run fails as a whole, and so does what starts inside it
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

#: A name, an assignment sign and the first operand; names may be quoted keys, dotted or subscripted. A run of name
#: characters is tried once, from its first letter, so that names may be of any length.
PAIR = re.compile(
    r"""(?:(?<![A-Za-z0-9_.\-])[0-9.\-]*+|(?=["']))(?P<q>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=q)[ \t]*(?P<sign>:=|=>|(?<![=!<>])=(?!=)|:(?!:|//))[ \t]*(?=\S)""", re.A
)
OPERAND = re.compile(r""""([^"\\\n]*(?:\\.[^"\\\n]*)*)"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)'|([A-Za-z_][A-Za-z0-9_.]*+(?=\+[ \t]*["'])|[A-Za-z0-9+/_.=@#$%^&*~!-]+)""", re.A)
#: What stands between a name's colon and the sign of the assignment: a type, as in `name: str = "..."`.
TYPE = re.compile(r"""[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\[\]"'\n=]*+\])*+(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\[\]"'\n=]*+\])*+)*+\??(?:[ \t]++=(?![=>])[ \t]*+(?=["'A-Za-z0-9_])|=(?![=>])[ \t]*+(?=["']))""", re.A)
PLUS = re.compile(r"[ \t]*(?:\+|\.\.|\.)[ \t]*(?=[\"'A-Za-z_])")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)

#: Fixed weights of the words of a target's name.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "bearer": 2, "private": 1, "access": 1, "auth": 1, "api": 1, "key": 1, "signing": 1, "salt": 1}
LEAST_SCORE = 3.0
LEAST_LENGTH = 6


def name_score(name: str) -> float:
    """How sensitive a target's name is, from its words in snake, kebab, dotted or camel case."""
    own = [w.lower() for w in WORD.findall(name)]
    return float(sum(SENSITIVE.get(w, 0) for w in dict.fromkeys(own)))


def literal_score(value: str) -> float:
    """What the literal itself adds: mixed character classes speak for a secret, plain lower-case words against."""
    if len(value) < LEAST_LENGTH or any(c.isspace() for c in value):
        return -3.0
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return -1.0 if classes < 2 else 0.5 * (classes - 1)


def pairs(text: str) -> list[tuple[str, list[tuple[int, int, str]], list[str]]]:
    """(name, literals as (start, end, value), names referred to) of the assignments in source or configuration."""
    out, at = [], 0
    while m := PAIR.search(text, at):
        at, literals, names = m.end(), [], []
        if m["sign"] == ":" and (t := TYPE.match(text, at)):
            at = t.end()
        while x := OPERAND.match(text, at):
            group = next(i for i in (1, 2, 3) if x[i] is not None)
            bare = group == 3
            if bare and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", x[3]):
                names.append(x[3])
            if x[group]:
                literals.append((x.start(group), x.end(group), x[group]))
            at = x.end()
            if not (p := PLUS.match(text, at)):
                break
            at = p.end()
        out.append((m["name"], literals, names))
        at = max(at, m.end())
    return out


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive target, themselves or through constants it refers to."""
    if "=" not in text and ":" not in text:
        return []
    found = pairs(text)
    defined: dict[str, list[tuple[int, int, str]]] = {}
    refers: dict[str, set[str]] = {}
    weight: dict[str, float] = {}
    for name, own, names in found:
        defined.setdefault(name, []).extend(own)
        refers.setdefault(name, set()).update(names)
        weight[name] = name_score(name)
    queue = [n for n in weight if weight[n] > 0]
    while queue:  # a constant is as sensitive as the most sensitive target it flows into
        n = queue.pop()
        for r in refers.get(n, ()):
            if r in weight and weight[r] < weight[n]:
                weight[r] = weight[n]
                queue.append(r)
    return sorted({(a, b) for n, own in defined.items() if weight[n] > 0 for a, b, v in own if v not in weight and weight[n] + literal_score(v) >= LEAST_SCORE})


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out + [(a, 3, b) for a, b in literals(text)])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs (doc_id, text).

    Spans are kind:start:end in code points, the end exclusive, by start and then kind, comma-joined; the kind
    literal is what lexing adds. Null and empty texts have none (the digest is that of the empty string). Repeated
    rows and null doc_ids keep a row each; other columns are not read.
    """

    def work(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                found = scan(t or "")
                base = ",".join([f"{KINDS[k]}:{a}:{e}" for a, k, e in found if k < 3])
                count = [sum(k == i for _, k, _ in found) for i in range(3)]
                out.append((*count, hashlib.sha256(base.encode()).hexdigest(), ",".join([f"{KINDS[k]}:{a}:{e}" for a, k, e in found])))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
