"""URL filters: host and path rules, then a weighted vocabulary found by Aho-Corasick.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest rule
that fits decides. Where none fits, one automaton reports every occurrence of a strict or soft term in the
url (A-Z lower-cased). An occurrence counts only between boundaries: the characters beside it are no letters
(ASCII letters, or anything beyond ASCII). One strict term blocks, and so do `min_soft` distinct soft terms.

One pass over the urls and no shuffle; rules and terms travel with the tasks, so they are checked to be at
most `MOST_TERMS`.

Edge cases: a null url, or one without "://", has an empty host and an empty path, so no rule fits; its text
is still searched for terms (null: none); repeated rows are judged alike; an empty table gives no rows. Other
columns are passed through, except those named like a result, which are replaced.
"""

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType

MOST_TERMS = 1_000_000
RESULT = ["host", "path", "rule", "verdict", "n_strict", "n_soft", "terms"]
#: (host, start of the path, verdict) of the rules the query applies.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
STRICT = ("bestiality", "camgirls", "hentai", "porn", "porno", "redtube", "warez", "xhamster", "xvideos", "xxx")
SOFT = (
    "adult", "bet", "betting", "cam", "cams", "casino", "crack", "dating", "erotic", "escort", "fetish", "gambling", "hookup", "hot", "keygen", "loan", "naked",
    "nude", "pills", "poker", "sex", "sexy", "slots", "teen", "torrent", "viagra", "webcam",
)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path; both empty without a scheme."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, stop)
    border = stop if slash < 0 else slash
    return rest[:border].translate(_LOWER), rest[border:stop]


class Vocabulary:
    """Strict and soft terms in one automaton."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.machine, self.size = ahocorasick.Automaton(), 0
        for weight, terms in ((1, soft), (2, strict)):  # a term in both lists is strict
            for term in terms:
                if term:
                    self.machine.add_word(term.translate(_LOWER), (len(term), term.translate(_LOWER), weight))
                    self.size += 1
        if self.size:
            self.machine.make_automaton()

    def hits(self, url: str | None) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms between boundaries."""
        strict, soft = set(), set()
        if not url or not self.size:
            return strict, soft
        text = url.translate(_LOWER)
        inner = lambda c: "a" <= c <= "z" or c > "\x7f"
        for last, (length, term, weight) in self.machine.iter(text):
            first = last - length + 1
            if (first and inner(text[first - 1])) or (last + 1 < len(text) and inner(text[last + 1])):
                continue
            (strict if weight == 2 else soft).add(term)
        return strict, soft


class Rules:
    """The longest rule for a host and path; among equally long ones that of the longer host."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, dict[str, str]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host.translate(_LOWER), {})[path] = verdict
        self.sizes = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.by_host.items()}

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict): one lookup for each suffix of the host and each length its rules have."""
        best, start = None, 0
        while host:
            own = host[start:]
            for size in self.sizes.get(own, ()):
                if path[:size] in self.by_host[own] and len(path) >= size:
                    if best is None or len(own) + size > len(best[0]):
                        best = own + path[:size], self.by_host[own][path[:size]]
                    break
            dot = host.find(".", start)
            if dot < 0:
                return best
            start = dot + 1
        return best


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    min_soft: int = 2, url: str = "url",
) -> DataFrame:
    """`pages` with `host`, `path`, `rule` (null without one), `verdict` (allow or block), the numbers of distinct
    `n_strict` and `n_soft` terms, and the sorted `terms`."""
    if len(rules) + len(strict) + len(soft) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} rules and terms")
    kept = [c for c in pages.columns if c not in RESULT]
    fields = [*kept, *RESULT]
    schema = pages.select(kept).schema
    for name, kind in zip(RESULT, [StringType()] * 4 + [IntegerType()] * 2 + [ArrayType(StringType())]):
        schema = schema.add(name, kind)
    types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.string())]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vocabulary = Rules(rules), Vocabulary(strict, soft)
        for batch in batches:
            rows = []
            for text in batch.column(len(kept)).to_pylist():
                host, path = split_url(text)
                found = known.find(host, path)
                hard, weak = vocabulary.hits(text)
                verdict = found[1] if found else "block" if hard or len(weak) >= min_soft else "allow"
                rows.append((host, path, found[0] if found else None, verdict, len(hard), len(weak), sorted(hard | weak)))
            cols = zip(*rows) if rows else [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, t) for c, t in zip(cols, types))], fields)

    return pages.select(*kept, pages[url].alias("judged url")).mapInArrow(judged, schema)
