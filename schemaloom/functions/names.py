"""Names of tables and columns: normal forms, tokens and display forms, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token lexicons, abbreviations, endings of key columns and key names that say nothing about their table.
TEMPORAL = ("date", "time", "timestamp", "datetime", "created", "updated", "start", "end", "expires")
STATUS = ("status", "state", "phase")
CATEGORY = ("category", "type", "class", "kind")
MEASURE = ("price", "cost", "amount", "total", "value", "score", "qty", "quantity", "rate", "weight")
IDENTIFIER = ("id", "identifier", "uuid", "pk", "fk", "code")
BOOLEAN = ("is", "has", "active", "enabled", "flag", "valid", "deleted", "archived")
CURRENCY = ("usd", "eur", "gbp", "brl", "cad", "aud", "jpy", "inr", "currency", "price", "cost", "amount")
UNIT = ("kg", "g", "lb", "m", "cm", "mm", "km", "s", "ms", "percent", "pct", "ratio")
ACRONYMS = {"id": "ID", "pk": "PK", "fk": "FK", "url": "URL", "uuid": "UUID"}
KEY_ENDINGS = ("code", "id", "key", "license", "ref", "no", "number", "num", "pk")
GENERIC_KEYS = ("id", "key", "code", "pk", "uuid", "guid")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literals(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_any(tokens: Column, values: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, literals(values))


def bare_key(c: Column | str) -> Column:
    """Lower case without anything but ASCII letters and digits; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "")


def trimmed_key(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def joined_key(c: Column | str) -> Column:
    """Lower case without white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"[\s\-_]+", "")


def spaceless_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", "")


def entity_part(c: Column | str) -> Column:
    """What stands before the first dot, trimmed; null without a dot."""
    c = col(c)
    return F.when(F.contains(c, F.lit(".")), F.trim(F.substring_index(c, ".", 1)))


def attribute_part(c: Column | str) -> Column:
    """What stands after the first dot, or all of it."""
    c = col(c)
    return F.regexp_replace(c, r"^[^.]*\.", "")


def last_part(c: Column | str) -> Column:
    """What stands after the last dot."""
    return F.substring_index(col(c), ".", -1)


def qualified_key(c: Column | str) -> Column:
    """bare_key on both sides of the first dot."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(F.contains(c, F.lit(".")), F.concat_ws(".", bare_key(F.substring_index(c, ".", 1)), bare_key(attribute_part(c)))).otherwise(bare_key(c))


def singular(token: Column) -> Column:
    """ies becomes y; a last s goes unless it ends ss, us or is; up to three letters stay."""
    plural = token.endswith("s") & ~token.rlike("(ss|us|is)$")
    n = F.length(token)
    return F.when(n <= 3, token).when(token.endswith("ies") & (n > 4), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y"))).when(plural, F.substring(token, F.lit(1), n - 1)).otherwise(token)


def chopped(token: Column) -> Column:
    """Without a last s if there are more than three letters."""
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def plain_tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def tokens(c: Column | str) -> Column:
    """Words of a name, parted at signs and before capitals, in lower case and singular."""
    parted = F.regexp_replace(F.coalesce(col(c), F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.filter(F.split(F.lower(F.regexp_replace(parted, "[^A-Za-z0-9]+", " ")), r"\s+"), lambda x: x != ""), singular)


def capital(token: Column) -> Column:
    return F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substring(token, F.lit(2), F.length(token))))


def term(words: Column) -> Column:
    """Title words; abbreviations in capitals."""
    known = F.create_map(*[F.lit(x) for pair in ACRONYMS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), capital(w))), " ")


def entity_label(c: Column | str) -> Column:
    """The display form of an entity's name: its tokens as a term, or the name if it has none."""
    label = term(tokens(c))
    return F.when(label == "", F.trim(col(c))).otherwise(label)


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"[\s_\-]+"), lambda x: x != "")


def camel(c: Column | str) -> Column:
    words = _words(col(c))
    rest = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), capital)
    return F.when(F.size(words) == 0, col(c)).otherwise(F.concat(F.lower(F.get(words, 0)), F.array_join(rest, "")))


def pascal(c: Column | str) -> Column:
    """Capitalised words; a single word with capitals inside keeps them."""
    words = _words(col(c))
    first = F.get(words, 0)
    kept = F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, F.lit(2), F.length(first)))
    return F.when((F.size(words) == 1) & first.rlike("^.+\\p{Lu}"), kept).otherwise(F.array_join(F.transform(words, capital), ""))


def table_label(c: Column | str) -> Column:
    """A name for an entity from a file's name: without folder and extension, in Pascal case."""
    name = F.regexp_replace(F.regexp_replace(col(c), r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", "")
    label = F.array_join(F.transform(F.filter(F.split(name, "[^A-Za-z0-9]+"), lambda x: x != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    return F.when(label == "", F.lit("Entity")).otherwise(label)


def key_label(c: Column | str) -> Column:
    """A name for an entity from its key column: the column without its key ending."""
    stem = F.regexp_replace(col(c), r"(?i)_?(id|key|code|license|ref|no|num|number|pk)$", "")
    return table_label(F.when(stem == "", col(c)).otherwise(stem))


def without_prefix(c: Column | str) -> Column:
    """Without a leading is, has or get that something follows."""
    return F.regexp_replace(col(c), "^(is|has|get)(?=.)", "")


def distinct_ignoring_case(values: Column) -> Column:
    """The first spelling of each value, in order."""
    return distinct_by(values, F.lower)


def distinct_by(values: Column, key) -> Column:
    """The first value of each key, in order; values whose key is null are left out.

    By sorting, as arrays may be long. What a lambda refers to outside is computed anew for each element, so arrays are
    handed in as elements of an array of one.
    """
    once = lambda array, f: F.get(F.transform(F.array(array), f), F.lit(0))
    heads = lambda s: F.filter(s, lambda x, j: x["key"].isNotNull() & ((j == 0) | ~x["key"].eqNullSafe(F.get(s, j - 1)["key"])))

    def firsts(array: Column) -> Column:
        keyed = F.sort_array(F.transform(array, lambda v, i: F.struct(key(v).alias("key"), i.alias("at"))))
        return F.transform(F.sort_array(F.transform(once(keyed, heads), lambda x: x["at"])), lambda i: F.get(array, i))

    return once(values, firsts)


def unordered_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def attribute_role(words: Column, is_pk: Column, is_fk: Column, entity_kind: Column) -> Column:
    """What an attribute does in its entity; the first rule that holds decides."""
    linked = entity_kind.isin("relator", "association")
    return (
        F.when(is_pk | has_any(words, IDENTIFIER), "identifier")
        .when(is_fk, "foreign_identifier")
        .when(linked & has_any(words, TEMPORAL), "relationship_temporal_qualifier")
        .when(linked & has_any(words, MEASURE), "relationship_measure_qualifier")
        .when(linked, "relationship_qualifier")
        .when(has_any(words, TEMPORAL), "temporal_quality")
        .when(has_any(words, STATUS), "status_quality")
        .when(has_any(words, CATEGORY), "categorical_quality")
        .when(has_any(words, MEASURE), "quantitative_quality")
        .otherwise("descriptive_quality")
    )


def preferred_term(words: Column, entity_words: Column, role: Column) -> Column:
    """The term that an attribute should map to: by its role, else its words without those of its entity."""
    core = F.filter(words, lambda w: ~F.array_contains(entity_words, w))
    core = F.when(F.size(core) == 0, words).otherwise(core)
    return (
        F.when(role.isin("identifier", "foreign_identifier"), "Identifier")
        .when(role.contains("temporal"), F.when(has_any(words, ("timestamp", "datetime", "time")), "Timestamp").otherwise("Date"))
        .when(role == "status_quality", "Status")
        .when(role == "categorical_quality", F.when(F.array_contains(words, "type"), "Type").otherwise("Category"))
        .otherwise(term(core))
    )
