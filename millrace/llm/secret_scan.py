"""Secret scan: three fixed patterns plus dictionary-primed zstandard novelty.

The patterns find assignments, access keys and long hex runs.  The novelty
method looks at every further token of key-like characters in a block (lines up to
blank ones) with a sensitive word, before or after it: it compresses the code before
the token with and without the token, under a zstandard dictionary of identifiers and
common code words, the document's own identifiers that share most with it and the text on both sides.
The bytes the token adds, over its length, say how little of it the dictionary
and its surroundings explain; what stays incompressible is reported.  Further copies
of a token don't explain it, unless the document uses it as an identifier elsewhere.
The body of a private key between PEM lines is one finding, across blank lines, too.

Null text counts as empty and has no spans.  Offsets are code points.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Maximal runs: asking for the least length in the pattern finds the same spans as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|authorization|auth|signature", re.IGNORECASE | re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*\n")
#: A private key; its body ends at the next dashes or, where these are missing, with the last line that is part of a key.
PEM = re.compile(r"""-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:((?:(?!-----).)+)(?=-----END)|((?:(?:\s|\\[nr]|["'+,])*[A-Za-z0-9+/=]{16,})+))""", re.DOTALL)
#: Words that code calls, sets, opens, defines or reaches through a dot.
USED = re.compile(r"""(?<![\w"'+/=-])(?:(?:def|class|function|func|fn|var|let|const|import)\x20+([A-Za-z_]\w{3,})|([A-Za-z_]\w{3,})(?=\x20?\(|\x20?=(?!=)|\.[A-Za-z_]|\[))|(?<=[\w)\]]\.)([A-Za-z_]\w{3,})(?![\w+/=-])""", re.ASCII)
#: Characters before a token that are compressed with it, and on both sides of it that prime the compression.
CONTEXT, AROUND = 48, 1024
#: Characters that an identifier must share with a token to explain it, and those by which identifiers are ordered.
SHARED, REACH = 4, 64
#: Least marginal compressed bytes a character for a token to be reported.
NOVELTY = 0.55
#: Fixed words that prime the compressor.
IDENTIFIERS = """
abstract access address algorithm alphabet application array assert async attribute author authorization await
background boolean bearer break buffer build bytes cache callback catch category certificate character class client
column command commit component config configuration connection const constructor container content context continue
controller cookie count create credential customer database default define delete description destination development
device dictionary directory document domain double download element email enable encoding encrypt endpoint engine
environment error event example exception execute expected export extends false file filter final finally float folder
format frame function gateway generate global group handler hash header height hidden history host identifier image
import include index information input instance integer interface internal iterator java javascript kernel key keyword
language length library license list listener local location logger login manager master maximum memory message method
minimum module monitor mutable namespace native network node null number object offset operator option order output
package page parameter parent password path pattern payload permission pointer policy port position prefix private
process production profile project property protected protocol provider public python query queue random range record
reference region register release remote repository request require resource response result return role root route
schedule schema scope script search secret section select sequence server service session setting signature size socket
source specification stack start state static status storage stream string struct subject submit success suffix switch
system table target task temp template test text thread throw timeout timestamp title token trace transaction transport
true tuple type undefined unique update upload user username value variable vector vendor version view virtual visible
volatile width window worker workspace wrapper write yield the of and to in that is was for on with as at by from
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ
"""


class Novelty:
    """Marginal compressed bytes of a token after its context, under the primed compressor."""

    def __init__(self):
        self.packer = self.primed("")

    @staticmethod
    def primed(more: str):
        import zstandard

        words = zstandard.ZstdCompressionDict((more + IDENTIFIERS).encode(errors="replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_checksum=False)

    def __call__(self, before: str, token: str, surroundings: str = "") -> float:
        packer = self.primed(surroundings) if surroundings else self.packer
        plain = len(packer.compress(before.encode(errors="replace")))
        return (len(packer.compress((before + token).encode(errors="replace"))) - plain) / len(token)


class Names:
    """A document's identifiers by all their suffixes in order: those that agree longest with a string at any of its places are
    neighbours of that place, so a token meets a few identifiers a character, however many there are."""

    def __init__(self, text: str):
        self.used: dict[str, list[int]] = {}
        for m in USED.finditer(text):
            self.used.setdefault(m[m.lastindex], []).append(m.start(m.lastindex))
        words = list(self.used)
        order = sorted((w[i : i + REACH], n) for n, w in enumerate(words) for i in range(len(w) - SHARED + 1))
        self.words, self.keys, self.of = words, [k for k, _ in order], [n for _, n in order]

    def near(self, start: int, end: int, token: str) -> list[str]:
        """The identifiers used outside start..end that share the longest stretch, of ``SHARED`` characters at least, with a place of ``token``."""
        found: set[int] = set()
        outside: dict[int, bool] = {}
        for i in range(len(token) - SHARED + 1):
            stretch = token[i : i + REACH]
            at = bisect.bisect_left(self.keys, stretch)
            for step, k in ((-1, at - 1), (1, at)):
                while 0 <= k < len(self.keys) and self.keys[k].startswith(stretch[:SHARED]):
                    n = self.of[k]
                    if n not in outside:
                        outside[n] = any(not start <= p < end for p in self.used[self.words[n]])
                    if outside[n]:
                        found.add(n)
                        break
                    k += step
        return [self.words[n] for n in sorted(found)]


class Surroundings:
    """What a document says about a token: whether its block is sensitive, and what may explain the token."""

    def __init__(self, text: str):
        self.text = text
        self.ends = [m.start() for m in BLANK.finditer(text)]
        self.sensitive: dict[int, tuple[int, int]] = {}
        self.names: Names | None = None

    def is_sensitive(self, start: int, end: int) -> bool:
        """Whether a sensitive word stands in the block beside the token; a word inside a token is none of its own."""
        k = bisect.bisect_left(self.ends, start)
        left, right = self.ends[k - 1] if k else 0, self.ends[k] if k < len(self.ends) else len(self.text)
        if k not in self.sensitive:
            words = [m.span() for m in SENSITIVE.finditer(self.text, left, right)]
            self.sensitive[k] = (words[0][1], words[-1][0]) if words else (len(self.text) + 1, -1)
        first_end, last_start = self.sensitive[k]
        return first_end <= start or last_start >= end

    def around(self, start: int, end: int) -> str:
        """The document's identifiers used elsewhere that may explain the token, and the text on both sides without copies of it."""
        if self.names is None:
            self.names = Names(self.text)
        token = self.text[start:end]
        sides = self.text[max(0, start - AROUND) : start] + " " + self.text[end : end + AROUND]
        return " ".join([sides.replace(token, " "), *self.names.near(start, end, token), ""])


def merged(taken: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint intervals that cover the same places."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(taken):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def spans(text: str | None, novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding, sorted; kind indexes KINDS."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in PEM.finditer(text) if "PRIVATE KEY" in text else ():
        body = m[m.lastindex]
        start, end = m.start(m.lastindex) + len(body) - len(body.lstrip()), m.end() - len(body) + len(body.rstrip())
        if end - start >= 16 and novelty("", text[start:end]) >= NOVELTY:
            found.append((start, 3, end))
    starts, ends = merged([(s, e) for s, _, e in found])
    document = Surroundings(text)
    for m in TOKEN.finditer(text):
        token = m[0]
        if not (re.search(r"[0-9]", token) and re.search(r"[A-Za-z]", token)) or not document.is_sensitive(m.start(), m.end()):
            continue
        k = bisect.bisect_left(starts, m.end()) - 1
        if k >= 0 and ends[k] > m.start():
            continue
        before = text[max(0, m.start() - CONTEXT) : m.start()].replace(token, " ")
        if novelty(before, token) >= NOVELTY and novelty(before, token, document.around(m.start(), m.end())) >= NOVELTY:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _named(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", redact: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``key``, the carried columns, n_assign, n_access, n_hex, n_novel, base_spans, spans; with ``redact`` the text
    with every finding replaced by that string, too.  Rows are independent; nothing is shuffled."""
    ship(docs.sparkSession)
    source = docs.select(docs[text].alias("t"), docs[key].alias("k"), *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)))
    counts = [f"n_{k}" for k in KINDS]
    kept = [T.StructField(n, f.dataType) for n, f in zip((key, *carry), source.schema[1:], strict=True)]
    fields = [*(T.StructField(c, T.LongType()) for c in counts), T.StructField("base_spans", T.StringType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    if redact is not None:
        fields.append(T.StructField("redacted", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out: list[list] = [[] for _ in fields]
                for t in b.column(0):
                    t = t.as_py()
                    found = spans(t, novelty)
                    for k in range(4):
                        out[k].append(sum(x[1] == k for x in found))
                    base = _named([x for x in found if x[1] < 3])
                    out[4].append(base)
                    out[5].append(hashlib.sha256(base.encode()).hexdigest())
                    out[6].append(_named(found))
                    if redact is not None:
                        out[7].append(_cut_out(t, found, redact))
                kinds = [pa.int64()] * 4 + [pa.string()] * (len(out) - 4)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, out, kinds)], names=[f.name for f in (*kept, *fields)])

    return source.mapInArrow(run, T.StructType([*kept, *fields]))


def _cut_out(text: str | None, found: list[tuple[int, int, int]], mark: str) -> str | None:
    if not found:
        return text
    parts, at = [], 0
    for s, _, e in found:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])
