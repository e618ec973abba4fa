"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bilingual list of words that carry no content.
STOP_WORDS = """a al algo ante antes como con contra cual cuando de del desde donde
durante e el ella ellas ellos en entre era eran es esa esas ese eso esos esta estas
este esto estos fue fueron ha han hasta hay la las le les lo los mas me mi mientras
muy nada ni no nos nosotros o os otra otros para pero poco por porque que quien se
ser si sin sobre son su sus te tiene tienen todo todos tu tus un una uno unos y ya
yo the a an and or of to in for on at is are was were be been it its this that with
i we you they he she my your our their not but so if as from had has have do does
did just very really there here all can will would about out up down them his her""".split()


def tokens(text: Column) -> Column:
    """Runs of more than two letters, lower-cased, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}{3,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*sorted({w for w in STOP_WORDS if len(w) > 2})))


def tokens_sql(text: str) -> str:
    """The same tokens in DuckDB SQL."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for w in STOP_WORDS if len(w) > 2}))
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '\\p{{L}}{{3,}}'), lambda t: t NOT IN ({stop}))"


def percent(x: Column) -> Column:
    """A share as text with one decimal."""
    return F.format_string("%.1f%%", x * 100)
