"""State and country codes; names that are not listed give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of states and their two-letter codes.
STATES = {
    "": "",
    "alabama": "al",
    "alaska": "ak",
    "arizona": "az",
    "arkansas": "ar",
    "california": "ca",
    "colorado": "co",
    "connecticut": "ct",
    "delaware": "de",
    "district of columbia": "dc",
    "florida": "fl",
    "georgia": "ga",
    "hawaii": "hi",
    "idaho": "id",
    "illinois": "il",
    "indiana": "in",
    "iowa": "ia",
    "kansas": "ks",
    "kentucky": "ky",
    "louisiana": "la",
    "maine": "me",
    "maryland": "md",
    "massachusetts": "ma",
    "michigan": "mi",
    "minnesota": "mn",
    "mississippi": "ms",
    "missouri": "mo",
    "montana": "mt",
    "nebraska": "ne",
    "nevada": "nv",
    "new hampshire": "nh",
    "new jersey": "nj",
    "new mexico": "nm",
    "new york": "ny",
    "north carolina": "nc",
    "north dakota": "nd",
    "ohio": "oh",
    "oklahoma": "ok",
    "oregon": "or",
    "pennsylvania": "pa",
    "rhode island": "ri",
    "south carolina": "sc",
    "south dakota": "sd",
    "tennessee": "tn",
    "texas": "tx",
    "utah": "ut",
    "vermont": "vt",
    "virginia": "va",
    "washington": "wa",
    "west virginia": "wv",
    "wisconsin": "wi",
    "wyoming": "wy",
}

# Names of countries and territories, with the code of the state that they count for.
COUNTRIES = {
    "": "",
    "united states": "us",
    "singapore": "sg",
    "japan": "jp",
    "cayman islands": "ky",
    "korea, republic of": "kr",
    "netherlands": "nl",
    "germany": "de",
    "ireland": "ie",
    "switzerland": "ch",
    "china": "cn",
    "france": "fr",
    "canada": "ca",
    "united kingdom": "uk",
    "finland": "fi",
    "luxembourg": "lu",
    "taiwan": "tw",
    "puerto rico": "us",
    "hong kong": "hk",
    "great britain": "uk",
    "sweden": "se",
    "stateless": "",
    "england": "uk",
    "barbados": "bb",
    "bermuda": "bm",
    "italy": "it",
    "denmark": "dk",
    "israel": "il",
    "australia": "au",
    "ontario": "ca",
    "belgium": "be",
    "not provided": "",
    "virgin islands, british": "vg",
    "cyprus": "cy",
    "austria": "at",
    "norway": "no",
    "russian federation": "ru",
    "india": "in",
    "spain": "es",
    "korea, democratic people's republic of": "kp",
    "new zealand": "nz",
    "guernsey": "gg",
    "samoa": "ws",
    "saudi arabia": "sa",
    "mexico": "mx",
    "malaysia": "my",
    "brazil": "br",
    "south africa": "za",
    "scotland": "uk",
    "hungary": "hu",
    "netherlands antilles": "an",
    "british columbia": "ca",
    "liechtenstein": "li",
    "seychelles": "sc",
    "portugal": "pt",
    "quebec": "ca",
    "united arab emirates": "ae",
    "german democratic republic": "de",
    "malta": "mt",
    "isle of man": "im",
    "panama": "pa",
    "bahamas": "bs",
    "iceland": "is",
    "georgia": "ge",
    "channel islands": "uk",
    "alberta": "ca",
    "thailand": "th",
    "czech republic": "cz",
    "mauritius": "mu",
    "philippines": "ph",
    "namibia": "na",
    "chile": "cl",
    "saint kitts and nevis": "kn",
    "jersey": "je",
    "argentina": "ar",
    "turks and caicos islands": "tc",
    "gibraltar": "gi",
    "manitoba": "ca",
    "belize": "bz",
    "wales": "uk",
    "turkey": "tr",
    "greece": "gr",
    "slovakia": "sk",
    "virgin islands, u.s.": "us",
    "cook islands": "ck",
    "poland": "pl",
    "macao": "mo",
    "nova scotia": "ca",
    "anguilla": "ai",
    "colombia": "co",
    "iran, islamic republic of": "ir",
    "monaco": "mc",
    "marshall islands": "mh",
    "croatia": "hr",
    "sri lanka": "lk",
    "venezuela": "ve",
    "jordan": "jo",
    "brunei darussalam": "bn",
    "saskatchewan": "ca",
    "uruguay": "uy",
    "estonia": "ee",
    "ukraine": "ua",
    "northern ireland": "uk",
    "cuba": "cu",
    "liberia": "lr",
    "kuwait": "kw",
    "qatar": "qa",
    "san marino": "sm",
    "romania": "ro",
    "cocos (keeling) islands": "cc",
    "slovenia": "si",
    "antigua and barbuda": "ag",
    "swaziland": "sz",
    "vanuatu": "vu",
    "papua new guinea": "pg",
    "latvia": "lv",
    "union of soviet socialist republics": "ru",
    "curacao": "cw",
    "costa rica": "cr",
    "viet nam": "vn",
    "england and wales": "uk",
    "norfolk island": "au",
    "macau": "mo",
    "jamaica": "jm",
    "bulgaria": "bg",
    "european union": "eu",
    "trinidad and tobago": "tt",
    "newfoundland and labrador": "ca",
    "armenia": "am",
    "czechoslovakia": "cz",
    "guam": "gu",
    "andorra": "ad",
    "algeria": "dz",
    "indonesia": "id",
    "belarus": "by",
    "azerbaijan": "az",
    "dominica": "dm",
    "peru": "pe",
    "dominican republic": "do",
    "aruba": "aw",
    "british indian ocean territory": "io",
    "oman": "om",
    "guadeloupe": "fr",
    "ecuador": "ec",
    "lithuania": "lt",
    "lebanon": "lb",
    "prince edward island": "ca",
    "kazakstan": "kz",
    "botswana": "bw",
    "christmas island": "cx",
    "pakistan": "pk",
    "american samoa": "as",
    "saint lucia": "lc",
    "saint vincent and the grenadines": "vc",
    "tunisia": "tn",
    "grenada": "gd",
    "serbia": "rs",
    "benin": "bj",
    "mauritania": "mr",
    "morocco": "ma",
    "saint helena": "sh",
    "bangladesh": "bd",
    "french polynesia": "pf",
    "chad": "td",
    "yemen": "ye",
    "syrian arab republic": "sy",
    "nothern mariana islands": "mp",
    "uzbekistan": "uz",
    "rwanda": "rw",
    "guatemala": "gt",
    "new brunswick": "ca",
    "burundi": "bi",
}


def _lookup(table: dict[str, str], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), name)


def state_code(name: Column) -> Column:
    return _lookup(STATES, name)


def country_code(name: Column) -> Column:
    return _lookup(COUNTRIES, name)
