"""Job parameters. The defaults equal the reference's constants."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # ABC limits on the running share, in percent (class A <= 80, B <= 95, else C)
    limit_a: int = 80
    limit_b: int = 95
    # ranking sizes
    top_n: int = 10
    bottom_n: int = 10
    # annotation batching and the number of newest periods that get annotated
    batch_size: int = 15
    annotated_periods: int = 7


DEFAULT = Params()

# Column names of the reference's raw sales export (fixed values).
RAW_STORE = "FtoResumoVendaGeralItem[loja_id]"
RAW_PRODUCT = "FtoResumoVendaGeralItem[material_descr]"
RAW_VALUE = "FtoResumoVendaGeralItem[vl_total]"
RAW_DATE = "FtoResumoVendaGeralItem[dt_contabil]"
RAW_COLUMNS = (RAW_STORE, RAW_PRODUCT, RAW_VALUE, RAW_DATE)

# Our short names for the four fact columns after the scan.
STORE, PRODUCT, VALUE_RAW, DATE_RAW = "store_id", "product", "value_raw", "date_raw"
