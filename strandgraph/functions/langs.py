"""Language families and the gates that keep references inside them (R16)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages that share a runtime.
FAMILY = {
    "java": "jvm", "kotlin": "jvm", "scala": "jvm", "swift": "apple", "objc": "apple",
    "typescript": "web", "tsx": "web", "javascript": "web", "jsx": "web",
    "c": "c", "cpp": "c", "csharp": "dotnet", "razor": "dotnet",
}


def family(language: Column) -> Column:
    """Family of a language, null when it stands alone."""
    return F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[language]


def same_family(a: Column, b: Column) -> Column:
    return (a == b) | F.coalesce(family(a) == family(b), F.lit(False))


def crosses_known(a: Column, b: Column) -> Column:
    return family(a).isNotNull() & family(b).isNotNull() & ~same_family(a, b)


def gate(ref_kind: Column, cand_lang: Column, ref_lang: Column) -> Column:
    """Type uses stay in the family; imports do not cross two known families."""
    return (
        F.when(ref_kind.isin("references", "function_ref"), same_family(cand_lang, ref_lang))
        .when(ref_kind == "imports", ~crosses_known(cand_lang, ref_lang))
        .otherwise(True)
    )
