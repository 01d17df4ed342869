"""Column-expression helpers shared by the operators (all JVM-side)."""

from loomkit.functions.exprs import (  # noqa: F401
    hash_unit,
    r6,
    safe_div,
    slugify,
    split_bucket,
)
from loomkit.functions.prefix import prefix_sums, dense_index  # noqa: F401
