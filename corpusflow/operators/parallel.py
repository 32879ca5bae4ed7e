"""Spreading a scan over the cores there are."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Plans with one of these are more than a scan: counting their partitions might run them.
_MORE = re.compile(r"\b(Join|Aggregate|Window|Sort|Repartition|RepartitionByExpression|RebalancePartitions|Generate|Distinct|Deduplicate|GlobalLimit|LocalLimit|Offset|Expand|Sample|Union|MapInArrow|MapInPandas|LogicalRDD|InMemoryRelation)\b")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it is a mere scan in fewer.

    A file of one row group, however much work its rows are, is one task; large inputs have partitions enough and aren't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if _MORE.search(execution.optimizedPlan().toString()):
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df
