"""Query text helpers (plain Python on the short query) and scoring Columns on node rows."""

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANGUAGES, NODE_KINDS
from .paths import basename, dirname, is_test_file

# Words that carry no signal in a search query.
STOP_WORDS = set(
    "the a an and or but in on at to for of with by from is it that this are was be has had have "
    "do does did will would could should may might can shall not no all each every how what where "
    "when who which why i me my we our you your he she they show give tell been done made used "
    "using work works found also into then than just more some such over only out its so up as if "
    "look need needs want happen happens affect affected break breaks failing implemented "
    "implement code file files function method class type fix bug called".split()
)
# Ranking bonus by node kind.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6,
    "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4, "property": 3, "field": 3,
    "variable": 2, "constant": 3, "import": 1, "export": 1, "parameter": 0, "namespace": 4,
    "file": 0, "protocol": 9, "enum_member": 3,
}
# Qualifiers of a path that name no directory.
PATH_QUALIFIERS = {"crate", "super", "self"}

TOKEN = r"[\p{L}\p{N}\p{Co}]"


# -- query parsing ------------------------------------------------------------

@dataclass
class SearchQuery:
    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def parse_query(raw: str) -> SearchQuery:
    """Split `kind:`, `lang:`, `path:` and `name:` filters from the free text of a query."""
    out, words = SearchQuery(), []
    # A word runs to the next blank; a quoted span inside it may hold blanks.
    for word in re.findall(r'(?:[^\s"]|"[^"]*"|"[^"]*$)+', raw):
        key, colon, value = word.partition(":")
        if len(value) >= 2 and value[0] == value[-1] == '"':
            value = value[1:-1]
        key = key.lower()
        if not (colon and key and value):
            words.append(word)
        elif key == "kind" and value in NODE_KINDS:
            out.kinds.append(value)
        elif key in ("lang", "language") and value.lower() in LANGUAGES:
            out.languages.append(value.lower())
        elif key == "path":
            out.paths.append(value)
        elif key == "name":
            out.names.append(value)
        else:
            words.append(word)
    out.text = " ".join(words).strip()
    return out


# Fixed values: (ending, shortest word, letters taken off, what may stand instead, endings it gives way to).
# "=" stands for the rest without its doubled last letter.
ENDINGS = [
    ("ing", 6, 3, ["", "e", "="], ()), ("tion", 6, 3, [""], ()), ("sion", 6, 3, [""], ()), ("ment", 7, 4, [""], ()),
    ("ies", 5, 3, ["y"], ()), ("es", 5, 2, [""], ("ies",)), ("s", 5, 1, [""], ("es", "ss")),
    ("ed", 5, 1, [""], ("eed",)), ("ed", 5, 2, [""], ("eed",)), ("ied", 6, 3, ["y"], ()), ("er", 5, 2, ["", "e", "="], ()),
]


def stem_variants(term: str) -> list[str]:
    """Shorter forms of a word; they serve as prefixes, so they need not be words."""
    word, forms = term.lower(), {}
    for ending, shortest, taken, instead, stronger in ENDINGS:
        if len(word) < shortest or not word.endswith(ending) or word.endswith(stronger):
            continue
        rest = word[:-taken]
        for tail in instead:
            if tail != "=":
                forms[rest + tail] = True
            elif rest[-2:-1] == rest[-1:]:
                forms[rest[:-1]] = True
    return [form for form in forms if len(form) > 2]


def split_camel(text: str) -> str:
    text = re.sub(r"([a-z])([A-Z])", r"\1 \2", text)
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text)


def _compound(word: str) -> bool:
    """An identifier of several parts: joined by underscores, or by capitals that begin words."""
    if not word[0].isalpha():
        return False
    if "_" in word:
        return all(word.split("_"))
    humps = re.findall(r"[A-Z][a-z]*|[a-z0-9]+", word)
    ends = len(humps[-1]) > 1 and humps[-1][0].isupper()
    return len(humps) > 1 and (ends or (len(humps[0]) > 1 and all(h[0].isupper() for h in humps)))


def search_terms(query: str, stems: bool = True) -> list[str]:
    """Lower-case search terms of a query: whole identifiers, their parts, stems."""
    words = re.findall(r"\w+", query, re.ASCII)
    parts = [part for word in words for part in re.findall(r"[A-Za-z0-9]+", split_camel(word))]
    kept = [w for w in words if _compound(w)] + [p for p in parts if p.lower() not in STOP_WORDS]
    terms = dict.fromkeys(w.lower() for w in kept if len(w) > 2)
    if stems:
        terms |= dict.fromkeys(v for t in list(terms) for v in stem_variants(t) if v not in STOP_WORDS)
    return list(terms)


def is_distinctive(token: str) -> bool:
    """A token typed as an identifier: underscore, digit or an inner capital."""
    return bool(re.search(r"[_0-9]|.[A-Z]", token))


def project_tokens(*names: str) -> set[str]:
    """Normalised project names of at least five characters."""
    plain = (re.sub(r"[^a-z0-9]", "", n.lower()) for n in names if n)
    return {n for n in plain if len(n) >= 5}


# -- folding and tokens -------------------------------------------------------

@lru_cache
def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _plain(column: Column) -> Column:
    """Text of single-byte characters only, for which cheaper rules do."""
    return F.octet_length(column) == F.length(column)


def fold(column: Column | str) -> Column:
    """Lower case without accents, as the full-text tokenizer compares words."""
    column = F.col(column) if isinstance(column, str) else column
    lower = F.lower(column)
    return F.when(_plain(column), lower).otherwise(F.translate(lower, *_accents()))


def fold_text(text: str) -> str:
    table = dict(zip(*_accents()))
    return "".join(table.get(c, c) for c in text.lower())


def token_count(folded: Column) -> Column:
    count = F.when(_plain(folded), F.regexp_count(folded, F.lit("[a-z0-9]+"))).otherwise(F.regexp_count(folded, F.lit(f"{TOKEN}+")))
    return F.coalesce(count, F.lit(0))


def tokens(folded: Column) -> Column:
    """The words of a folded text; none for null."""
    words = F.when(_plain(folded), F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), 1)).otherwise(
        F.regexp_extract_all(folded, F.lit(f"({TOKEN}+)"), 1))
    return F.coalesce(words, F.array().cast("array<string>"))


def phrase_tokens(term: str) -> list[str]:
    out = "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " "
                  for c in fold_text(term))
    return out.split()


def phrase_hits(folded: Column, tokens: list[str]) -> Column:
    """Occurrences of a phrase whose last token is a prefix; overlaps count."""
    gap = f"(?!{TOKEN})[^\\p{{L}}\\p{{N}}\\p{{Co}}]+"
    rest = "".join(f"{gap}{re.escape(t)}" for t in tokens[1:])
    pattern = f"(?<!{TOKEN}){re.escape(tokens[0])}" + (f"(?={rest})" if rest else "")
    # A plain substring test spares most texts the regex.
    return F.when(folded.contains(tokens[0]), F.regexp_count(folded, F.lit(pattern))).otherwise(0)


def phrase_count(words: Column, phrase: Column) -> Column:
    """The same count on the words of a text, for a phrase that is a value: (n, head, last), where `head` holds all
    words but the last, joined by blanks."""
    before = phrase["n"] - 1

    def at(word: Column, place: Column) -> Column:
        return (F.array_join(F.slice(words, place + 1, before), " ") == phrase["head"]) & F.coalesce(
            F.startswith(F.get(words, place + before), phrase["last"]), F.lit(False))

    alone = F.filter(words, lambda word: F.startswith(word, phrase["last"]))
    return F.size(F.when(before == 0, alone).otherwise(F.filter(words, at)))


def fts_phrases(text: str) -> list[list[str]]:
    """Phrases of a full-text query: blanks separate, operators and syntax are dropped."""
    words = re.sub(r"""['"*():^]""", "", text.replace("::", " ")).split()
    words = [w for w in words if w.upper() not in ("AND", "OR", "NOT", "NEAR")]
    return [p for p in (phrase_tokens(w) for w in words) if p]


# -- scores -------------------------------------------------------------------

def kind_bonus(kind: Column | str = "kind") -> Column:
    pairs = [F.lit(x) for kv in KIND_BONUS.items() for x in kv]
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.coalesce(F.create_map(*pairs)[kind], F.lit(0))


def _has_any(column: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | column.contains(w)
    return out


def _name_parts(query: str) -> list[str]:
    parts = [t.lower() for t in re.split(r"[\s_.\-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query))]
    return [t for t in parts if len(t) >= 2]


def name_bonus(name: Column | str, query: str) -> Column:
    """How well a name matches the query: 80 whole, 60 one word, 10-40 prefix, 15 all parts, 10 inside."""
    lower = F.lower(F.col(name) if isinstance(name, str) else name)
    parts = _name_parts(query)
    words = [t.lower() for t in query.split() if len(t) >= 2]
    whole = re.sub(r"\s+", "", query).lower()
    score = F.when(lower == whole, 80.0)
    if len(words) > 1:
        score = score.when(lower.isin(words), 60.0)
    score = score.when(lower.startswith(whole), F.floor(10.5 + 30.0 * len(whole) / F.length(lower)).cast("double"))
    if len(parts) > 1:
        every = F.lit(True)
        for p in parts:
            every = every & lower.contains(p)
        score = score.when(every, 15.0)
    return score.when(lower.contains(whole), 10.0).otherwise(0.0)


def path_relevance(path: Column | str, query: str, project: set[str] = frozenset()) -> Column:
    """Per query word 10 for the file name plus 5 for a directory or 3 for elsewhere in the path."""
    path = F.col(path) if isinstance(path, str) else path
    words = query.split()
    if not words:
        return F.lit(0)
    kept = [w for w in words if re.sub(r"[^a-z0-9]", "", w.lower()) not in project] or words
    lower = F.lower(path)
    file, folder = basename(lower), dirname(lower, ".")
    score = F.lit(0)
    for word in kept:
        terms = search_terms(word, stems=False)
        if terms:
            score = score + F.when(_has_any(file, terms), 10).otherwise(0)
            score = score + F.when(_has_any(folder, terms), 5).when(_has_any(lower, terms), 3).otherwise(0)
    if not re.search("test|spec", query.lower()):
        score = score - F.when(is_test_file(path), 15).otherwise(0)
    return score


def term_bonus(path: str, name: str, at: str, terms: list[str]) -> Column:
    """path_relevance plus name_bonus for the term of number `at` among single-word terms; the terms are values,
    so the expression is as long for many as for one."""
    def value(of) -> Column:
        return F.array(*[_literal(of(t)) for t in terms])[F.col(at)]

    def any_in(column: Column, words: Column) -> Column:
        return F.exists(words, lambda w: F.contains(column, w))

    lower, words = F.lower(path), value(lambda t: search_terms(t, stems=False))
    file, folder = basename(lower), dirname(lower, ".")
    near = F.when(any_in(file, words), 10).otherwise(0) + F.when(any_in(folder, words), 5).when(any_in(lower, words), 3).otherwise(0)
    near = near - F.when(is_test_file(path), value(lambda t: 0 if re.search("test|spec", t.lower()) else 15)).otherwise(0)
    low, whole, parts = F.lower(name), value(str.lower), value(_name_parts)
    share = F.floor(F.lit(10.5) + value(lambda t: 30.0 * len(t)) / F.length(low)).cast("double")
    named = F.when(low == whole, 80.0).when(F.startswith(low, whole), share).when(
        (F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(low, p)), 15.0).when(F.contains(low, whole), 10.0).otherwise(0.0)
    return near + named


def _literal(value) -> Column:
    return F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, list) else F.lit(value)


def matches_symbol(symbol: str) -> Column:
    """Does a node answer to `symbol`: its name, a file stem, or a qualified or path-like form."""
    name, kind = F.col("name"), F.col("kind")
    hit = (name == symbol) | ((kind == "file") & (F.regexp_replace("name", r"\.[^.]+$", "") == symbol))
    parts = [p for p in re.split(r"::|[./]", symbol) if p]
    if not re.search(r"[./]|::", symbol) or len(parts) < 2:
        return hit
    inner = F.col("qualified_name").contains("::".join(parts))
    hints = [p for p in parts[:-1] if p not in PATH_QUALIFIERS]
    if hints:
        segments = F.split("file_path", "/")
        stems = F.transform(segments, lambda s: F.regexp_replace(s, r"\.[^.]+$", ""))
        every = F.lit(True)
        for h in hints:
            every = every & (F.array_contains(segments, h) | F.array_contains(stems, h))
        inner = inner | every
    return hit | ((name == parts[-1]) & inner)
