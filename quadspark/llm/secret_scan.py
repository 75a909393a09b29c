"""Secret scan with multipart credential linking.

Base patterns (an assigned secret, an access identifier, a long hex run) are
always reported. Weak parts (a user or client identifier, an opaque token, an
endpoint) count only where complementary parts lie in the same scope: an
interval join of the weak parts' intervals, widened by ``scope_chars``, with
the intervals of the other roles. A scope never leaves a document, so the join
is a sorted sweep beside the scan and nothing is shuffled.

Defined results: a null text is an empty text; an empty text has no findings;
rows are independent of each other, so ties and repeated rows give equal
findings; an input column of the output's name is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: the three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of 20 characters or more
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs of 24 or more

# Weak parts: reported only with their complements.
USER = re.compile(r"""(?:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
USER_KEYS = ("user", "login", "client", "account", "access")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""https?://[^\s"'<>|]{4,}""", re.I | re.A)

KINDS = ("assign", "access", "hex", "user", "opaque", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "user": "identifier", "endpoint": "endpoint"}
#: A weak kind and the roles that must all lie in its scope.
NEEDS = {"user": ("secret",), "opaque": ("identifier",), "endpoint": ("secret", "identifier")}
FINDING = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans in code points, end exclusive, in no order."""
    low, out = text.lower(), []
    if any(k in low for k in ASSIGN_KEYS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _mixed(token: str) -> bool:
    """Letters and digits, with 3.2 bits a character or more."""
    if not (re.search(r"[0-9]", token) and re.search(r"[A-Za-z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 3.2


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    low, out = text.lower(), []
    if any(k in low for k in USER_KEYS):
        out += [("user", m.start(), m.end()) for m in USER.finditer(text)]
    if not out and not any(ROLE[k] == "identifier" for k, _, _ in base):
        return []  # every link holds an identifier
    out += [("opaque", m.start(), m.end()) for m in OPAQUE.finditer(text) if _mixed(m[0])]
    if "://" in text:
        out += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    free = lambda s, e: (i := bisect_left(starts, e)) == 0 or reach[i - 1] <= s
    return [x for x in out if free(x[1], x[2])]


def link(base: list[tuple[str, int, int]], weak: list[tuple[str, int, int]], scope_chars: int) -> list[tuple[str, int, int]]:
    """The weak spans with every complementary role within ``scope_chars``: an interval join on sorted ends."""
    starts: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for kind, s, e in [*base, *weak]:
        starts.setdefault(ROLE[kind], []).append(s)
        ends.setdefault(ROLE[kind], []).append(e)
    for v in [*starts.values(), *ends.values()]:
        v.sort()

    def near(role: str, s: int, e: int) -> bool:
        return role in starts and bisect_right(starts[role], e + scope_chars) > bisect_left(ends[role], s - scope_chars)

    return [x for x in weak if all(near(r, x[1], x[2]) for r in NEEDS[x[0]])]


def find_secrets(text: str | None, scope_chars: int = 400) -> list[tuple[str, int, int]]:
    """All findings of one text, by start and then kind as listed in KINDS."""
    if not text:
        return []
    base = base_spans(text)
    weak = weak_spans(text, base)
    return sorted([*base, *link(base, weak, scope_chars)], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(df: DataFrame, text: str = "text", scope_chars: int = 400, output: str = "findings") -> DataFrame:
    """``df`` with ``output``: array of (kind, start, end) in code points, end exclusive."""

    @F.pandas_udf(FINDING)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t, scope_chars)] for t in texts], dtype=object)

    return df.withColumn(output, scan(F.col(text)))


def redact_secrets(df: DataFrame, text: str = "text", scope_chars: int = 400) -> DataFrame:
    """``df`` with every finding replaced by ``<KIND>``; overlapping findings merge under the first's kind."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = find_secrets(t, scope_chars)
            if found:
                parts, at = [], 0
                for kind, s, e in found:
                    if s >= at:
                        parts += [t[at:s], f"<{kind.upper()}>"]
                    at = max(at, e)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    return df.withColumn(text, redact(F.col(text)))


def span_text(findings, kinds=KINDS):
    """kind:start:end, comma-joined, as a Column over the findings."""
    kept = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import load

    found = scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(n(k).alias(f"n_{k}") for k in BASE),
        F.sha2(span_text(F.col("findings"), BASE), 256).alias("base_sha256"),
        span_text(F.col("findings")).alias("spans"),
    )
