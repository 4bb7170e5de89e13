"""Ledgers derived from the test tables, in SQL text that Spark and DuckDB both read.

Every order appears in every ledger. The order priority decides how the two sides differ, so that
all result classes occur; orders of status ``P`` have blank second-key columns on both sides, which
makes one key hold a third of all rows.
"""

_AMOUNT = "cast(o_totalprice as decimal(18,2))"
_DOC = "cast(o_orderkey as string)"
_CUST = "case when o_orderstatus = 'P' then '' else cast(o_custkey as string) end"
_DAY = "case when o_orderstatus = 'P' then '' else cast(cast(o_orderdate as date) as string) end"

LEDGER_A = f"""
select 2 * o_orderkey as row_id, {_DOC} as doc, {_CUST} as cust, {_DAY} as dia,
       case when o_orderstatus = 'F' then replace(cast({_AMOUNT} as string), '.', ',')
            else cast({_AMOUNT} as string) end as valor
from orders"""


def ledger_b(sign: str = "") -> str:
    """Side B; orders of priority 5-LOW and status F come in two rows, the second one of 10.00."""
    first = f"""cast({_AMOUNT} + case
            when o_orderpriority = '1-URGENT' then 0.50
            when o_orderpriority = '2-HIGH' then 100.00
            when o_orderpriority = '3-MEDIUM' then -100.00
            when o_orderpriority = '5-LOW' and o_orderstatus = 'F' then -10.00
            else 0.00 end as decimal(18,2))"""
    common = f"""
       case when o_orderpriority = '4-NOT SPECIFIED' then 'X' || {_DOC} else {_DOC} end as doc,
       case when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'O' then 'Y' || {_CUST}
            else {_CUST} end as cust,
       {_DAY} as dia,
       case when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then 'S'
            when o_orderpriority = '5-LOW' then null else 'N' end as indicador"""
    return f"""
select 2 * o_orderkey as row_id, {common}, cast({sign}{first} as string) as valor from orders
union all
select 2 * o_orderkey + 1 as row_id, {common}, '{sign}10.00' as valor
from orders where o_orderpriority = '5-LOW' and o_orderstatus = 'F'"""


LEDGER_B = ledger_b()
LEDGER_B_NEGATIVE = ledger_b("-")

_THOUSANDS = "cast(floor(o_totalprice / 1000) * 1000 as decimal(18,2))"

# Side A with reversals: 1-URGENT is reversed exactly, 2-HIGH but for 0.30, and all 3-MEDIUM orders
# share one document whose few amounts repeat and are reversed for status P only.
LEDGER_R = f"""
select 2 * o_orderkey as row_id,
       case when o_orderpriority = '3-MEDIUM' then 'LOTE' else {_DOC} end as doc, '' as ref,
       {_CUST} as cust, {_DAY} as dia,
       case when o_orderpriority = '3-MEDIUM' then cast({_THOUSANDS} as string)
            else cast({_AMOUNT} as string) end as valor
from orders
union all
select 2 * o_orderkey + 1 as row_id, '' as doc,
       case when o_orderpriority = '3-MEDIUM' then 'LOTE' else {_DOC} end as ref,
       {_CUST} as cust, {_DAY} as dia,
       case when o_orderpriority = '1-URGENT' then cast(-{_AMOUNT} as string)
            when o_orderpriority = '2-HIGH' then cast(cast(0.30 - {_AMOUNT} as decimal(18,2)) as string)
            else cast(-{_THOUSANDS} as string) end as valor
from orders
where o_orderpriority in ('1-URGENT', '2-HIGH')
   or (o_orderpriority = '3-MEDIUM' and o_orderstatus = 'P')"""

# Lines of one supplier; returned lines reverse lines of like amount.
LEDGER_LINES = """
select row_id, case when l_returnflag = 'R' then '' else cast(l_suppkey as string) end as doc,
       case when l_returnflag = 'R' then cast(l_suppkey as string) else '' end as ref,
       case when l_returnflag = 'R' then cast(-cast(l_extendedprice as decimal(18,2)) as string)
            else cast(cast(l_extendedprice as decimal(18,2)) as string) end as valor
from lineitem_rows"""

# Every order is document and reference of its customer's group at once, with amounts within the
# tolerance of each other and around zero, so that many rows could meet themselves.
LEDGER_DUAL = """
select o_orderkey as row_id, cast(o_custkey % 200 as string) as doc,
       case when o_orderstatus = 'O' then '' else cast(o_custkey % 200 as string) end as ref,
       cast(cast(((o_orderkey % 5) - 2) * 0.1 as decimal(18,2)) as string) as valor
from orders"""

# One document key holds two thirds of all orders with a few dozen amounts, each within the tolerance
# of the next ones; the other keys are small ledgers of the same kind.
_HOT_KEY = "case when o_orderstatus = 'O' then 'C' || cast(o_custkey % 50 as string) else 'LOTE' end"
_IS_A = "o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')"
LEDGER_HOT = f"""
select o_orderkey as row_id, case when {_IS_A} then {_HOT_KEY} else '' end as doc,
       case when {_IS_A} then '' else {_HOT_KEY} end as ref,
       cast(cast(case when {_IS_A} then 1 else -1 end * (cast(floor(o_totalprice) as bigint) % 60) * 0.25
            as decimal(18,2)) as string) as valor
from orders"""

ORIGIN = """
select c_custkey as row_id, cast(c_custkey as string) as cust, c_mktsegment as seg,
       ' ' || c_name || ' ' as nome,
       case when c_acctbal < 0 then '' else cast(cast(c_acctbal as decimal(18,2)) as string) end
       as saldo
from customer"""

DESTINATION = """
select o_orderkey as row_id,
       case when o_orderstatus = 'P' then null else cast(o_custkey as string) end as cust,
       case when o_orderpriority = '1-URGENT' then 'BUILDING'
            when o_orderpriority = '2-HIGH' then 'MACHINERY'
            when o_orderpriority = '3-MEDIUM' then 'NONE' else '' end as seg,
       case when o_orderpriority = '5-LOW' then 'Null' when o_orderpriority = '2-HIGH' then '0.00'
            when o_orderpriority = '1-URGENT' then null else o_orderpriority end as nome,
       o_orderstatus as situacao
from orders"""

# Remarks over several lines, with quotes and commas in them.
REMARKS = f"""
select o_orderkey as row_id, {_DOC} as doc,
       case when o_orderstatus = 'F' then 'linha 1' || chr(10) || chr(10) || '"' || {_DOC} || '", fim' || chr(10)
            when o_orderstatus = 'O' then '5" cano' else 'uma linha, ' || {_DOC} end as nota,
       cast({_AMOUNT} as string) as valor
from orders"""

# Texts as found in hand-kept sheets: comma and point decimals, blanks, marks, thousands points.
TEXTS = f"""
select o_orderkey as row_id,
       case when o_orderpriority = '1-URGENT' then replace(cast({_AMOUNT} as string), '.', ',')
            when o_orderpriority = '2-HIGH' then '  ' || cast({_AMOUNT} as string) || ' '
            when o_orderpriority = '3-MEDIUM' then 'R$ ' || cast({_AMOUNT} as string)
            when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'F' then ''
            when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'O' then null
            when o_orderpriority = '4-NOT SPECIFIED' then ' NULL '
            when o_orderstatus = 'F' then '1.' || replace(cast({_AMOUNT} as string), '.', ',')
            when o_orderstatus = 'O' then '-' || cast({_AMOUNT} as string)
            else '0' end as valor,
       case when o_orderstatus = 'F' then '' when o_orderstatus = 'O' then ' ' else o_orderpriority
       end as nota
from orders"""

# Values of all kinds that a sheet holds, for workbooks.
SHEET = """
select o_orderkey as row_id, o_orderkey as doc, o_totalprice as valor, floor(o_totalprice) as inteiro,
       o_orderstatus = 'F' as ativo, o_custkey as cliente,
       case when o_orderstatus = 'P' then '' else o_orderpriority || ' <&> "' end as nota
from orders"""
