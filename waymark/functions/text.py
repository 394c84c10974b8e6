"""Column functions on names, addresses and codes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The canonical service types, in their order.
SERVICES = ["Botrópico", "Crotálico", "Elapídico", "Laquético", "Escorpiônico", "Loxoscélico", "Foneutrico", "Lonômico"]

#: Other names of the service types, folded.
SERVICE_ALIASES = {
    "Botrópico": ["botropico", "bothrops", "jararaca", "cobra"],
    "Crotálico": ["crotalico", "cascavel", "crotalus"],
    "Elapídico": ["elapidico", "coral", "micrurus"],
    "Laquético": ["laquetico", "surucucu", "lachesis"],
    "Escorpiônico": ["escorpionico", "escorpiao", "escorpion", "tityus"],
    "Loxoscélico": ["loxoscelico", "aranha", "aranha marrom", "loxosceles"],
    "Foneutrico": ["foneutrico", "armadeira", "aranha armadeira", "phoneutria"],
    "Lonômico": ["lonomico", "lagarta", "lonomia"],
}

#: The letters that the stored search column folds.
STORED_FROM = "ÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇáàâãäéèêëíìîïóòôõöúùûüç"
STORED_TO = "AAAAAEEEEIIIIOOOOOUUUUCaaaaaeeeeiiiiooooouuuuc"


def _marks() -> tuple[str, str]:
    """Latin letters with marks and their base letters, then the marks alone (which have no counterpart and so are dropped)."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


ACCENTED, PLAIN = _marks()


def fold(c: Column) -> Column:
    """Without accents, for all Latin letters. Texts of one byte a character have none."""
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, ACCENTED, PLAIN))


def fold_stored(c: Column) -> Column:
    """The stored search form: lower case, only the letters of STORED_FROM folded."""
    return F.lower(F.translate(c, STORED_FROM, STORED_TO))


def search_key(c: Column) -> Column:
    """What both sides of an accent- and case-insensitive comparison go through."""
    return F.lower(fold(c))


def squeeze(c: Column) -> Column:
    """White space of any kind as single spaces, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def services(c: Column) -> Column:
    """The canonical service types whose folded names occur in a text, in canonical order."""
    folded = search_key(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(folded, search_key(F.lit(s))), F.lit(s)) for s in SERVICES]))


def canonical_service(c: Column) -> Column:
    """The service type a name or alias stands for; null if none."""
    key = F.trim(search_key(c))
    known = None
    for service, names in SERVICE_ALIASES.items():
        known = F.when(key.isin(names), F.lit(service)) if known is None else known.when(key.isin(names), F.lit(service))
    return known


#: What counts as noise in an address is defined by these patterns alone, removed in this order: a phone number with an area code, one
#: without, the mark for "no number", and what stands in brackets.
ADDRESS_NOISE = [
    r"\(\d{2,3}\)\s*\d{3,5}[-\s]?\d{3,5}",
    r"\b\d{4,5}[-\s]\d{4}\b",
    r"(?i)\bs/n[ºo°]?\b",
    r"\(.*?\)",
]

#: The shapes of a token that make it a phone number (anywhere in it; as a whole) and a facility code.
PHONE_WITHIN = r"\(\d{2}\)\s*\d{3,5}[-/]?\d{3,5}"
PHONE_WHOLE = r"^\d{3,5}[-/]\d{3,5}(/\d{3,4})?$"
CODE_WHOLE = r"^\d{7}$"


def clean_address(c: Column) -> Column:
    """Without noise, white space squeezed, none of ` ,-` at the ends."""
    for noise in ADDRESS_NOISE:
        c = F.regexp_replace(c, f"(?U){noise}", "")
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" ,-"))


def street(c: Column) -> Column:
    """What comes before the first comma or digit; all of it if nothing does."""
    head = F.regexp_extract(c, r"^([^,0-9]+)", 1)
    return F.when(head == "", c).otherwise(F.trim(head))


def token_class(c: Column) -> Column:
    """telefone (a phone number, or what begins one), cnes, atendimento, or null for free text."""
    t = F.btrim(c, F.lit(" ,.|"))
    phone = t.rlike(PHONE_WITHIN) | (t.startswith("(") & t.rlike("[0-9]")) | t.rlike(PHONE_WHOLE)
    service = F.btrim(search_key(t), F.lit(",.")).isin([names[0] for names in SERVICE_ALIASES.values()])
    return F.when(t == "", None).when(phone, "telefone").when(t.rlike(CODE_WHOLE), "cnes").when(service, "atendimento")


def postal_code(c: Column) -> Column:
    """The eight digits of a postal code; null if there aren't eight."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 8, digits)


def distance_label(km: Column) -> Column:
    return F.when(km < 1, F.concat(F.floor(km * 1000 + 0.5).cast("string"), F.lit(" m"))).when(km.isNotNull(), F.format_string("%.1f km", km))


def map_link(base: str, unit: Column, address: Column, city: Column) -> Column:
    """A search link for a place that has an address; else null."""
    query = F.concat_ws(" ", unit, address, city)
    return F.when(address.isNotNull() & (address != ""), F.concat(F.lit(f"{base}?query="), F.regexp_replace(F.url_encode(query), r"\+", "%20")))


def clamp(c: Column, default: int, most: int, least: int = 0) -> Column:
    """A request's number: default where it is missing or no number, within least and most."""
    return F.greatest(F.least(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(most)), F.lit(least))
