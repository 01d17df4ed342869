"""File sources and sinks."""

from loomkit.sources.files import (  # noqa: F401
    file_fingerprint, list_files, load_dataset, read_delimited, read_json, read_parquet,
    read_reports, write_table,
)
