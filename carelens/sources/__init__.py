"""Reading, converting and writing tables, plus adapter views over the supplied tables."""

from carelens.sources.tables import (  # noqa: F401
    convert_to_parquet, export_explanations, export_predictions, export_small_tables,
    load_table, load_tables, peek, persist_table, read_delimited, row_count, save_table,
)
