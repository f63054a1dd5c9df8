"""Declared table shapes."""

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


MANIFEST = (
    "image_id string, path string, dataset string, label int, media_type string, kind string, "
    "generator_family string, generator_variant string, content_category string, "
    "content_category_fixed string, category string, `group` string, source_path string, "
    "source_format string, source_file string, iso_week string, file_index bigint, ext string, "
    "width bigint, height bigint, file_format string, pil_mode string, file_bytes bigint, "
    "min_side bigint, max_side bigint, aspect double, megapixels double, bytes_per_pixel double, "
    "m_eval double, split string, split_unit string")

REGISTRY = ("name string, media_type string, path string, content_category string, "
            "generator_family string, generator_variant string, source_format string")

SAMPLE_META = "map<string, struct<source_file:string, model_name:string, iso_week:string>>"
SAMPLE_META_LIST = ("array<struct<source_file:string, filename:string, model_name:string, "
                    "iso_week:string>>")

TALLIES = "map<string, map<string, map<string, bigint>>>"

SCORED = ("row_id string, dataset string, y int, y3 int, d array<double>, d2 array<double>, "
          "view string")

LEDGER = ("ts timestamp, seq bigint, tag string, suite_version int, mode string, test string, "
          "split string, key map<string,string>, key_str string, n bigint, verdict string, "
          "headline string, higher_is_bad boolean, metrics map<string,double>, baseline boolean, "
          "delta double, regressed boolean")
