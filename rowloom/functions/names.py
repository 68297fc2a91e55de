"""Fake values of personal categories, picked from short word lists by hashed numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .random import index_below, uniform

WORDS = {
    "en_US": {
        "first": "Alice Brian Carla David Erin Frank Grace Henry Irene Jack Kelly Liam Mary Noah Olive Paul".split(),
        "last": "Adams Baker Clark Dixon Evans Foster Green Hayes Irwin Jones Keller Lewis Moore Nolan Owens Price".split(),
        "city": "Ashford Brookton Cedarville Dunmore Eastfield Fairview Glenwood Hillcrest".split(),
        "street": "Elm Street;Oak Avenue;Mill Road;Lake Drive;Hill Lane;Park Place;Bridge Street;Church Road".split(";"),
        "suffix": "Inc LLC Ltd Group".split(),
        "phone": "###-###-####",
    },
    "de_DE": {
        "first": "Anna Bernd Clara Dirk Emma Felix Greta Hans Ida Jan Karin Lukas Marie Nils Petra Ralf".split(),
        "last": "Albrecht Becker Conrad Dietrich Engel Fischer Graf Hoffmann Jung Keller Lang Meyer Neumann Otto Peters Richter".split(),
        "city": "Altdorf Birkenau Eichstadt Falkensee Grunwald Hochstadt Lindau Neustadt".split(),
        "street": "Hauptweg;Lindenallee;Ringweg;Schulgasse;Bergweg;Gartenallee;Feldweg;Seegasse".split(";"),
        "suffix": "GmbH AG KG Gruppe".split(),
        "phone": "0### #######",
    },
    "fr_FR": {
        "first": "Alain Brigitte Claude Denise Emile Fanny Gilles Helene Isabelle Jules Laure Marc Nadine Olivier Paule Rene".split(),
        "last": "Arnaud Bernard Colin Dubois Etienne Faure Garnier Henry Jacquet Lambert Martin Noel Olivier Perrin Renard Simon".split(),
        "city": "Aubigny Beaulieu Chateauneuf Fontenay Lavilledieu Montclair Rochefort Villeneuve".split(),
        "street": "rue du Lac;avenue du Parc;rue Haute;place du Marais;chemin Vert;rue Neuve;rue du Pont;allee des Pins".split(";"),
        "suffix": "SA SARL SAS Groupe".split(),
        "phone": "0# ## ## ## ##",
    },
}

Uniform = Callable[[str], Column]


def _word(words: list[str], u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index_below(u, len(words)) + 1).cast("int"))


def _digits(pattern: str, u: Uniform) -> Column:
    parts = [
        index_below(u(f"digit{i}"), 10).cast("string") if c == "#" else F.lit(c) for i, c in enumerate(pattern)
    ]
    return F.concat(*parts) if parts else F.lit("")


def _first(w, u):
    return _word(w["first"], u("first"))


def _last(w, u):
    return _word(w["last"], u("last"))


_MAKERS = {
    "first_name": _first,
    "last_name": _last,
    "name": lambda w, u: F.concat_ws(" ", _first(w, u), _last(w, u)),
    "email": lambda w, u: F.concat(
        F.lower(_first(w, u)), F.lit("."), F.lower(_last(w, u)), _digits("##", u), F.lit("@example.com")
    ),
    "phone_number": lambda w, u: _digits(w["phone"], u),
    "city": lambda w, u: _word(w["city"], u("city")),
    "address": lambda w, u: F.concat_ws(
        " ", (index_below(u("house"), 999) + 1).cast("string"), _word(w["street"], u("street"))
    ),
    "company": lambda w, u: F.concat_ws(" ", _last(w, u), _word(w["suffix"], u("suffix"))),
    "numerify": lambda w, u, pattern="###": _digits(pattern, u),
    "random_int": lambda w, u, low=0, high=9999: (index_below(u("int"), high - low + 1) + low).cast("string"),
}


def fake(category, u: Uniform, locale: str | list[str] | None = None) -> Column:
    """Fake value of ``category``; a tuple gives the category and its arguments.

    ``u`` maps the name of a random stream to a uniform number of the row. Of several locales each row draws one.
    """
    name, *args = category if isinstance(category, (tuple, list)) else (category,)
    locales = list(locale) if isinstance(locale, (list, tuple)) else [locale]
    locales = [x or "en_US" for x in locales] or ["en_US"]
    if name not in _MAKERS:
        raise ValueError(f'unknown category "{name}" of fake values')
    for x in locales:
        if x not in WORDS:
            raise ValueError(f'unknown locale "{x}" of fake values')
    made = [_MAKERS[name](WORDS[x], u, *args) for x in locales]
    return made[0] if len(made) == 1 else F.element_at(F.array(*made), (index_below(u("locale"), len(made)) + 1).cast("int"))


def keyed_uniform(value: Column, salt: str) -> Uniform:
    """Uniform numbers that depend on a secret salt and the value (52 bits of SHA-256)."""

    def u(stream: str) -> Column:
        text = F.concat(F.lit(f"{salt}/{stream}/"), value.cast("string"))
        bits = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("bigint")
        return (bits + F.lit(0.5)) * F.lit(2.0**-52)

    return u


def row_uniform(seed: int, field: str, *ids) -> Uniform:
    """Uniform numbers that depend on the output row only."""
    return lambda stream: uniform(seed, f"{field}/{stream}", *ids)
