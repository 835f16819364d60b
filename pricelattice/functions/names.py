"""Checks and splits of product names, packs and brands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise_pack

#: Names that are an adjective alone.
ADJECTIVES = (
    "Български[аяоеиу]?|Прясн[аяоеиу]|Нов[аяоеиу]?|Свеж[аяоеиу]?|Специаленъ?|Избран[аяоеиу]?|Домашн[аяоеиу]?|Натурален?|"
    "Пресни?|Зимни?|Лятн[аяоеиу]?"
)
#: Packaging words, in order of preference.
PACKAGING = [
    "кенче", "пакет", "кутия", "бутилка", "стъкло", "пластмасова", "консерва", "боричка", "чефтер", "сак", "саксия", "кашон", "свещи",
    "кутия", "пак", "промопакет", "запаян", "под ключ", "бидон", "типа", "капса",
]
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def is_product_name(c: Column) -> Column:
    """False for a name under two characters or one that is an adjective alone; null counts as no name."""
    name = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(name) >= 2) & ~name.rlike(f"(?iu)^({ADJECTIVES})$")


def pack_components(c: Column) -> Column:
    """Struct (generic_pack, pack_type): the first packaging word of the list that the pack holds, and the rest
    without it as a whole word."""
    pack = normalise_pack(c)
    kind = F.coalesce(*[F.when(pack.contains(k), F.lit(k)) for k in dict.fromkeys(PACKAGING)])
    rest = pack
    for k in dict.fromkeys(PACKAGING):
        rest = F.when(kind == k, F.regexp_replace(pack, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){k}(?![\p{{L}}\p{{N}}_])", "")).otherwise(rest)
    return F.struct(F.nullif(F.trim(rest), F.lit("")).alias("generic_pack"), kind.alias("pack_type"))


def split_brand(c: Column) -> Column:
    """Struct (brand, name) of a name that begins with a Latin word and goes on in Cyrillic; else (null, name)."""
    pattern = r"^([A-Za-z0-9.\-&]+)\s+(.+)$"
    rest = F.regexp_extract(c, pattern, 2)
    found = c.rlike(pattern) & rest.rlike(r"[Ѐ-ӿ]")
    return F.struct(F.when(found, F.regexp_extract(c, pattern, 1)).alias("brand"), F.when(found, F.trim(rest)).otherwise(c).alias("name"))


def is_transliteration(name: Column, brand: Column) -> Column:
    """Whether a one-word Cyrillic name looks like a one-word Latin brand: lengths within three."""
    near = F.abs(F.length(name) - F.length(brand)) <= 3
    return F.coalesce(name.rlike(r"^[Ѐ-ӿ]+$") & brand.rlike(r"^[A-Za-z'\-]+$") & near, F.lit(False))


def category_uuid(c: Column) -> Column:
    """The version 5 UUID of a category in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(F.concat(F.lit("category:"), c), "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def title_case(c: Column) -> Column:
    """The text without space around it, every letter after a character that is none in upper case, all others in lower case."""
    pieces = F.split(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
