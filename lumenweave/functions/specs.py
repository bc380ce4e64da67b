"""Text forms of the command surface as column expressions; null where a text is none of the form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import parse_pixel_format

# fixed values: spellings of a boolean setting
BOOLEANS = ("true", "false", "1", "0", "yes", "no", "on", "off")
MOST = (1 << 32) - 1


def _whole(text: Column) -> Column:
    """A whole number of 32 bits."""
    v = F.when(text.rlike("^[0-9]{1,12}$"), text.try_cast("long"))
    return F.when(v <= MOST, v)


def frame_rate(text: Column) -> Column:
    """(num, den) of `25`, `30000/1001` or `29.97`, which is 2997 of 100: decimals are kept as digits. Both are above zero."""
    t = F.trim(text)
    part = lambda form, k: F.regexp_extract(t, form, k)
    ratio, point = "^([0-9]+)/([0-9]+)$", "^([0-9]+)[.]([0-9]+)$"
    digits = part(point, 2)
    num = F.when(t.rlike(ratio), _whole(part(ratio, 1))).when(t.rlike(point), _whole(F.regexp_replace(F.concat(part(point, 1), digits), "^0+(?=[0-9])", ""))).otherwise(_whole(t))
    den = F.when(t.rlike(ratio), _whole(part(ratio, 2))).when(t.rlike(point), _whole(F.rpad(F.lit("1"), F.length(digits) + 1, "0"))).otherwise(F.lit(1))
    return F.when((num > 0) & (den > 0), F.struct(num.alias("num"), den.cast("long").alias("den")))


def video_spec(text: Column) -> Column:
    """(width, height, sampling, depth) of `1920x1080:yuv420p10le`."""
    form = "^([0-9]+)[xX]([0-9]+):(.+)$"
    w, h, f = _whole(F.regexp_extract(text, form, 1)), _whole(F.regexp_extract(text, form, 2)), parse_pixel_format(F.regexp_extract(text, form, 3))
    return F.when((w > 0) & (h > 0) & f.isNotNull(), F.struct(w.alias("width"), h.alias("height"), f["sampling"].alias("sampling"), f["depth"].alias("depth")))


def codec_path(text: Column) -> Column:
    """(codec, path), split at the first colon, neither empty."""
    form = "^([^:]+):(.+)$"
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).alias("codec"), F.regexp_extract(text, form, 2).alias("path")))


def setting(text: Column) -> Column:
    """(name, value) of `name=value`; a bare name means true."""
    at = F.instr(text, "=")
    return F.struct(F.substring_index(text, "=", 1).alias("name"), F.when(at > 0, F.substr(text, at + 1)).otherwise("true").alias("value"))


def accepts(value: Column, choices: tuple[str, ...] = BOOLEANS, between: tuple[int, int] | None = None) -> Column:
    """Whether a setting may have the value: one of the choices or, with `between`, a whole number in the range."""
    if between is None:
        return F.coalesce(value.isin(*choices), F.lit(False))
    return F.coalesce(_whole(value).between(*between), F.lit(False))


def config_error(codec: Column, pixels: Column, rate: Column, settings: Column, *, name: str, formats: tuple[str, ...], lossless: tuple[str, ...], takes: dict[str, tuple]) -> Column:
    """What is wrong first with an encoder's configuration, null if nothing: `codec`, `format`, `lossless`, or a kind and the setting it is about.

    rate is `lossless`, `quantiser` or anything else; settings is an array of `name=value`. `takes` gives each setting its choices, or (least, most) as two numbers.
    A setting may be in conflict with the rate, given twice, unknown, or have a value that is not taken.
    """
    both = F.transform(settings, setting)

    def wrong(s: Column, i: Column) -> Column:
        n, v = s["name"], s["value"]
        clash = (n == "lossless") | ((n == "qp") & rate.isin("lossless", "quantiser"))
        twice = F.exists(F.slice(both, 1, i), lambda t: t["name"] == n)
        fits = F.lit(False)
        for k, what in takes.items():
            numbers = len(what) == 2 and all(isinstance(x, int) for x in what)
            fits = fits | ((n == k) & (accepts(v, between=what) if numbers else accepts(v, what)))
        bad = F.when(clash, "conflict").when(twice, "twice").when(~n.isin(*takes), "unknown").when(~fits, "value")
        return F.concat(bad, F.lit(" "), n)

    first = F.get(F.filter(F.transform(both, wrong), lambda e: e.isNotNull()), F.lit(0))
    start = F.when(codec != name, "codec").when(~pixels.isin(*formats), "format").when((rate == "lossless") & ~pixels.isin(*lossless), "lossless")
    return F.coalesce(start, first)
