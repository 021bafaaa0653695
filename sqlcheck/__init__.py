"""Independent SQL statements of the registered queries, for checking results in another engine."""

from sqlcheck.facts import S as FACTS
from sqlcheck.items import S as ITEMS
from sqlcheck.pack import PACK
from sqlcheck.quality import S as QUALITY


def all_statements() -> dict[str, str]:
    return {**PACK, **FACTS, **ITEMS, **QUALITY}
