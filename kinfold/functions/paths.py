"""Names and paths of catalog items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join_path(*parts: Column) -> Column:
    """Parts joined by one slash: a trailing slash is not doubled, an absolute part starts anew."""
    out = parts[0]
    for p in parts[1:]:
        out = F.when(p.startswith("/"), p).when((out == "") | out.endswith("/"), F.concat(out, p)).otherwise(F.concat(out, F.lit("/"), p))
    return out


def image_path(directory: Column, image_id: Column, suffix: str = ".jpg") -> Column:
    """The processed image of an item: ``<directory>/<image_id>.jpg``."""
    return F.concat(directory, F.lit("/"), image_id.cast("string"), F.lit(suffix))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def from_template(template: str, *values: Column) -> Column:
    """A ``{}`` template filled in order; ``%`` stays literal."""
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *values)
