"""Programs and graphs derived from the driver's tables by plain arithmetic.

The SQL runs in Spark and in other engines alike; table names are placeholders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagmar.functions.scalars import NUMBER
from dagmar.sources.program import Program, ProgramGraph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: An edge of every customer row, whatever the table's size.
EDGES = "SELECT c_custkey AS src, (c_custkey*c_custkey+1) % n AS dst FROM {customer} CROSS JOIN (SELECT count(*) AS n FROM {customer}) AS size"

IR_BLOCKS = "SELECT DISTINCT CAST((o_orderkey - o_orderkey % 8)/8 AS BIGINT)+1 AS block_id, CAST((o_orderkey - o_orderkey % 32)/32 AS BIGINT)+1 AS func_id FROM {orders}"

IR_INST = """
SELECT *, CASE WHEN lhs_var IS NOT NULL THEN dest_ty WHEN lhs_const IS NOT NULL THEN 'int' END AS lhs_ty,
          CASE WHEN rhs_var IS NOT NULL THEN dest_ty WHEN rhs_const IS NOT NULL THEN 'int' END AS rhs_ty FROM (
SELECT o_orderkey+1 AS inst_id, CAST((o_orderkey - o_orderkey % 8)/8 AS BIGINT)+1 AS block_id, o_orderkey % 8 AS pos,
 CASE o_orderkey % 8 WHEN 0 THEN 'Assign' WHEN 1 THEN 'Assign' WHEN 2 THEN 'Add' WHEN 3 THEN 'Mul' WHEN 4 THEN 'Sub'
                     WHEN 5 THEN 'Assign' WHEN 6 THEN 'Add' ELSE 'Call' END AS op,
 o_orderkey+1 AS dest, CASE WHEN o_custkey % 97 = 0 THEN 'uint' ELSE 'int' END AS dest_ty,
 CASE o_orderkey % 8 WHEN 2 THEN o_orderkey-1 WHEN 3 THEN o_orderkey-2 WHEN 4 THEN o_orderkey-1
                     WHEN 5 THEN o_orderkey-2 WHEN 6 THEN o_orderkey WHEN 7 THEN o_orderkey END AS lhs_var,
 CASE o_orderkey % 8 WHEN 0 THEN o_custkey % 10 WHEN 1 THEN o_custkey % 7 END AS lhs_const,
 CASE o_orderkey % 8 WHEN 2 THEN o_orderkey WHEN 6 THEN o_orderkey-1 END AS rhs_var,
 CASE o_orderkey % 8 WHEN 3 THEN 0 WHEN 4 THEN 0 END AS rhs_const,
 CASE o_orderkey % 8 WHEN 7 THEN o_custkey % 16 + 1 END AS callee FROM {orders}) AS raw
"""

IR_TERM = """
SELECT block_id, CASE (block_id-1) % 4 WHEN 0 THEN 'Branch' WHEN 3 THEN 'Return' ELSE 'Jump' END AS kind,
 CASE (block_id-1) % 4 WHEN 0 THEN block_id+1 WHEN 1 THEN block_id+2 WHEN 2 THEN block_id+1 END AS t1,
 CASE (block_id-1) % 4 WHEN 0 THEN block_id+2 END AS t2,
 CASE (block_id-1) % 4 WHEN 0 THEN (block_id % 8 = 1) END AS cond_const,
 CASE (block_id-1) % 4 WHEN 3 THEN block_id*8-1 END AS ret_var FROM ({ir_blocks}) AS b
"""

V_NODES = """
SELECT p_partkey*8+j AS node_id, CASE j WHEN 0 THEN 'Constant' WHEN 1 THEN 'Parameter' WHEN 2 THEN 'Add'
 WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Sub' ELSE 'Add' END WHEN 4 THEN 'Return' WHEN 5 THEN 'End' ELSE 'Constant' END AS kind,
 CASE j WHEN 2 THEN p_partkey*8+1 WHEN 3 THEN p_partkey*8+2 END AS lhs,
 CASE j WHEN 2 THEN p_partkey*8 WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN p_partkey*8+2 ELSE p_partkey*8+7 END END AS rhs,
 CASE j WHEN 0 THEN p_size % 4 WHEN 6 THEN 9 WHEN 7 THEN p_size % 4 END AS u8
FROM {part} CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) AS t(j)
"""

V_VALUE_EDGES = """
SELECT p_partkey*8+2 AS src, p_partkey*8+1 AS dst FROM {part} UNION ALL SELECT p_partkey*8+2, p_partkey*8 FROM {part}
UNION ALL SELECT p_partkey*8+3, p_partkey*8+2 FROM {part}
UNION ALL SELECT p_partkey*8+3, CASE WHEN p_partkey % 2 = 0 THEN p_partkey*8+2 ELSE p_partkey*8+7 END FROM {part}
UNION ALL SELECT p_partkey*8+4, p_partkey*8+3 FROM {part}
"""

V_CONTROL_EDGES = "SELECT p_partkey*8+5 AS src, p_partkey*8+4 AS dst FROM {part}"

G_ENODES = """
SELECT p_partkey*4+j AS id, CASE j WHEN 2 THEN 'Sub' WHEN 3 THEN 'Add' ELSE 'Constant' END AS op,
 CASE j WHEN 2 THEN p_partkey*4+1 WHEN 3 THEN p_partkey*4 END AS lhs, CASE j WHEN 2 THEN p_partkey*4 WHEN 3 THEN p_partkey*4+2 END AS rhs
FROM {part} CROSS JOIN (VALUES (0),(1),(2),(3)) AS t(j)
"""


class Tables:
    """The driver's tables as attributes, and fixtures over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = text.replace("{ir_blocks}", IR_BLOCKS)
        used = {n: getattr(self, n) for n in TABLES if f"{{{n}}}" in text}
        return self.spark.sql(text, **used)

    def edges(self) -> DataFrame:
        return self.sql(EDGES)

    def enodes(self) -> DataFrame:
        return self.sql(G_ENODES)

    def program(self) -> Program:
        n = lambda c: F.col(c).cast(NUMBER).alias(c)
        null = lambda c, t: F.lit(None).cast(t).alias(c)
        insts, blocks, ends = self.sql(IR_INST), self.sql(IR_BLOCKS), self.sql(IR_TERM)
        return Program(
            instructions=insts.select("inst_id", "op", "dest", "dest_ty", "lhs_var", n("lhs_const"), "lhs_ty", "rhs_var", n("rhs_const"), "rhs_ty", "callee", F.array().cast(f"array<struct<var:bigint,const:{NUMBER},ty:string>>").alias("args"), null("name", "string")),
            block_instructions=insts.select("inst_id", "block_id", "pos"),
            terminators=ends.select("block_id", "kind", null("cond_var", "bigint"), "cond_const", "t1", "t2", "ret_var", null("ret_const", NUMBER), F.when(F.col("ret_var").isNotNull(), "int").alias("ret_ty")),
            blocks=blocks.select("block_id", null("name", "string")),
            function_blocks=blocks.select("block_id", "func_id"),
            functions=blocks.select("func_id").distinct().select("func_id", F.concat(F.lit("f"), F.col("func_id").cast("string")).alias("name"), F.lit("int").alias("ret_ty"), ((F.col("func_id") - 1) * 4 + 1).alias("entry"), F.array().cast("array<struct<var:bigint,ty:string>>").alias("params")),
        )

    def graph(self) -> ProgramGraph:
        null = lambda c, t: F.lit(None).cast(t).alias(c)
        nodes = self.sql(V_NODES)
        owner = F.floor(F.col("node_id") / F.lit(8)).cast("bigint")
        return ProgramGraph(
            value_edges=self.sql(V_VALUE_EDGES),
            effect_edges=self.spark.createDataFrame([], "src bigint, dst bigint"),
            control_edges=self.sql(V_CONTROL_EDGES),
            nodes=nodes.select("node_id", "kind", "lhs", "rhs", null("cmp_kind", "string"), F.col("u8").cast("int").alias("u8"), null("b", "boolean"), null("arr", "array<int>"), F.when(F.col("kind").isin("Constant", "Parameter"), "u8").alias("ty")),
            function_nodes=nodes.select("node_id", owner.alias("func_id")),
            functions=nodes.select(owner.alias("func_id")).distinct().select("func_id", F.concat(F.lit("p"), F.col("func_id").cast("string")).alias("name")),
        )


    def program_tables(self) -> Program:
        """program() as written tables, as it would be in practice: passes of many joins plan faster over columns than over the fixture's expressions."""
        return self.program().written(self.spark)

    def graph_tables(self) -> ProgramGraph:
        return self.graph().written(self.spark)


def oracle(text: str) -> str:
    """Fixture SQL with the tables' own names."""
    return text.replace("{ir_blocks}", IR_BLOCKS).format(**{n: n for n in TABLES})


#: Common table expressions that oracles share.
IR_CTE = f"ir_blocks AS ({oracle(IR_BLOCKS)}), ir_inst AS ({oracle(IR_INST)}), ir_term AS ({oracle(IR_TERM)})"
V_CTE = f"v_nodes AS ({oracle(V_NODES)}), v_value AS ({oracle(V_VALUE_EDGES)}), v_control AS ({oracle(V_CONTROL_EDGES)}), v_edges AS (SELECT * FROM v_value UNION ALL SELECT * FROM v_control)"
E_CTE = f"e AS ({oracle(EDGES)})"
G_CTE = f"g AS ({oracle(G_ENODES)})"
