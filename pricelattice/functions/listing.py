"""Listing titles, brochure names, categories and slugs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import is_transliteration
from .packs import PRICE
from .text import collapse, decomposed

#: Sub-categories under their top category.
TAXONOMY = {
    "Млечни продукти": ["Сирене", "Кисело мляко", "Прясно мляко", "Краве масло и маргарин", "Яйца", "Сметана и крем", "Млечни десерти"],
    "Месо, риба и колбаси": ["Прясно месо", "Птиче месо", "Риба и морски дарове", "Колбаси и наденица", "Готови месни продукти"],
    "Плодове и зеленчуци": ["Плодове", "Зеленчуци", "Гъби и маслини"],
    "Хляб, тестени и зърнени": ["Хляб и питки", "Тестени изделия", "Брашно и зърнени", "Ориз и бобови"],
    "Сладкиши и снаксове": ["Шоколад и бонбони", "Бисквити и вафли", "Торти и кексове", "Сладолед", "Чипс и солени снаксове"],
    "Напитки": ["Вода и минерална вода", "Сокове и безалкохолни", "Кафе", "Чай и какао", "Бира", "Вино", "Спиртни напитки"],
    "Подправки и консерви": [
        "Олио и мазнини", "Подправки и сосове", "Консерви и буркани", "Захар, сол и подсладители", "Замразени храни",
    ],
    "Специални": ["Детски храни", "Диетични и здравословни"],
    "Домашни любимци": ["Домашни любимци"],
    "Дом и хигиена": ["Почистващи препарати", "Хигиенни продукти", "Козметика и грижа за тяло", "Домакински стоки"],
    "Нехранителни стоки": ["Електроника", "Дрехи и обувки", "Спорт и свободно време", "Цветя и растения"],
    "Друго": ["Друго"],
}
OTHER = "Друго"
#: Latin food words and their Bulgarian names.
FOOD_WORDS = {
    "filet": "Филе", "fillet": "Филе", "schnitzel": "Шницел", "steak": "Стейк", "grill": "Грил", "burger": "Бургер", "nuggets": "Нъгетс",
    "salami": "Салами", "bacon": "Бекон", "pizza": "Пица", "pasta": "Паста", "yogurt": "Йогурт", "yoghurt": "Йогурт", "cheese": "Сирене",
    "butter": "Масло", "cream": "Крем", "milk": "Мляко", "juice": "Сок", "water": "Вода", "beer": "Бира", "wine": "Вино",
}
#: Own-label brands at the start of a listing title, the longer ones first.
OWN_BRANDS = ["Metro Chef", "Metro Premium", "Metro Quality", "Metro"]
#: Fixed value: the size at the end of a listing title.
TITLE_SIZE = r"(?isU)\s+(\d[\d\s,.]*(?:[xх]\s*\d+)?)\s*(гр?|кг|мл|л|бр|пак)\s*$"
#: Fixed value: a quantity with its unit in a line of text.
UNIT = r"(?iuU)\b(\d+(?:[.,]\d+)?\s*(?:кг|г|л|мл|бр|пак|kg|g|l|ml|pc|pcs)\.?)\b"
LEAST_NAME = 3


def valid_category(c: Column) -> Column:
    """A known sub-category as it is, any other text as the catch-all; null and empty text as null."""
    known = [sub for subs in TAXONOMY.values() for sub in subs]
    return F.when(c.isin(known), c).when(c != "", F.lit(OTHER))


def top_category(c: Column) -> Column:
    """The top category of a text's valid category."""
    tops = F.create_map(*[F.lit(x) for top, subs in TAXONOMY.items() for sub in subs for x in (sub, top)])
    return F.try_element_at(tops, valid_category(c))


def repaired_name(c: Column) -> Column:
    """A name of Cyrillic and Latin letters with its Latin food words in Bulgarian; null if Latin letters remain. Names of one
    script stay."""
    swapped = reduce(lambda x, w: F.regexp_replace(x, f"(?i)(?<![A-Za-z]){w[0]}(?![A-Za-z])", f" {w[1]}"), FOOD_WORDS.items(), c)
    mixed = c.rlike("[A-Za-z]") & c.rlike("[Ѐ-ӿ]")
    return F.when(~mixed, c).when(~swapped.rlike("[A-Za-z]"), collapse(swapped))


def is_brand_name(name: Column, brand: Column) -> Column:
    """Whether a name is its brand, or looks like the brand in Cyrillic letters; false where either is missing."""
    n, b = F.trim(name), F.trim(brand)
    return F.coalesce((b != "") & ((F.lower(n) == F.lower(b)) | is_transliteration(n, b)), F.lit(False))


def listing_title(title: Column, shown_pack: Column, own_brands: list[str] = OWN_BRANDS) -> Column:
    """Struct (name, brand, pack_info) of a title: an own-label brand leads it, a size ends it. Without a size the pack shown
    beside it counts, unless that is one piece. A title that is a brand and a size alone is its own name."""
    raw = F.trim(title)
    brand = reduce(lambda x, b: x.when(F.upper(raw).startswith(b.upper()), F.lit(b)), own_brands, F.when(F.lit(False), F.lit("")))
    rest = F.when(brand.isNull(), raw).otherwise(F.ltrim(F.substring(raw, F.length(brand) + 1, F.length(raw)), F.lit(" -–")))
    sized = rest.rlike(TITLE_SIZE)
    size = F.concat_ws(" ", F.trim(F.regexp_extract(rest, TITLE_SIZE, 1)), F.lower(F.regexp_extract(rest, TITLE_SIZE, 2)))
    shown = F.nullif(F.trim(shown_pack), F.lit(""))
    pack = F.when(sized, size).when(~shown.rlike(r"(?iuU)^1\s*брой$"), F.lower(shown))
    name = F.when(sized, F.trim(F.regexp_replace(rest, TITLE_SIZE, ""))).otherwise(rest)
    return F.struct(F.coalesce(F.nullif(name, F.lit("")), raw).alias("name"), brand.alias("brand"), pack.alias("pack_info"))


def unit_text(c: Column) -> Column:
    """The first quantity with a unit in a text, or null."""
    return F.nullif(F.trim(F.regexp_extract(c, UNIT, 1)), F.lit(""))


def brochure_name(block: Column) -> Column:
    """Struct (name, unit) of a block of lines whose last one has the price. Lines of digits alone or under three characters
    do not count; prices, marks at the ends and units go. Null name if under three characters are left."""
    trimmed = F.transform(F.split(block, "\n"), lambda x: F.trim(x))
    lines = F.filter(trimmed, lambda x: (F.length(x) >= LEAST_NAME) & ~x.rlike(r"(?U)^[\d\s.,]+$"))
    name = F.btrim(F.regexp_replace(F.array_join(lines, " "), PRICE, ""), F.lit(" -–—·•"))
    unit = F.coalesce(unit_text(F.element_at(trimmed, -1)), unit_text(name))
    bare = F.when(unit.isNull(), name).otherwise(F.trim(F.regexp_replace(name, UNIT, "")))
    return F.struct(F.when(F.length(name) >= LEAST_NAME, bare).alias("name"), unit.alias("unit"))


def ascii_slug(name: Column, barcode: Column, row_key: Column) -> Column:
    """ASCII slug of a name, with the last four characters of a barcode. A name without ASCII letters or digits gets twelve
    digits of the hash of ``row_key``, so that reruns agree."""
    ascii_only = F.regexp_replace(F.lower(F.regexp_replace(decomposed(name), r"[^\x00-\x7F]", "")), r"[^\w\s-]", "")
    slug = F.btrim(F.regexp_replace(ascii_only, r"[-\s]+", "-"), F.lit("-"))
    own = F.coalesce(F.nullif(slug, F.lit("")), F.substring(F.sha1(row_key.cast("string").cast("binary")), 1, 12))
    return F.concat_ws("-", own, F.nullif(F.right(barcode, F.lit(4)), F.lit("")))
