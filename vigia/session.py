"""Session settings the wide jobs are measured with; jobs themselves change no setting."""

from __future__ import annotations

# Cleaning some forty columns in one fused stage generates a method of more than 8,000
# bytes of bytecode, which the JVM leaves uncompiled. With this limit Spark keeps such a
# stage in separately compiled projections; on 40 columns that is more than twice as fast.
# For the session's builder: SparkSession.builder.config(map=WIDE_ROWS).
WIDE_ROWS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
