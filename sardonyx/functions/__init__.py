"""Column expressions built from ``pyspark.sql.functions`` only (JVM-side, codegen)."""

from sardonyx.functions.text import (  # noqa: F401
    label_to_int,
    row_key,
    strip_ws,
    tokens,
    url_domain,
)
from sardonyx.functions.numeric import (  # noqa: F401
    argmax,
    cross_entropy,
    dot_const,
    hash_unit,
    logsumexp,
    softmax,
)
