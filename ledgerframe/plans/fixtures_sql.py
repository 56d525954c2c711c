"""DuckDB text of the ERP test tables (the SQL twin of ``sources/demo.py``).

Used only by the oracle queries: each is valid DuckDB over the driver's views and yields the
same rows as the DataFrame derivation, which the cross-engine tests check table by table.
"""

FIXTURE_SQL: dict[str, str] = {
    "apca_t": (
        "select case when o_orderkey % 50 = 0 then 100 else 666 end apcaent, 'AP-'||lpad(cast(o_orderkey "
        "as string),8,'0') apcadocno, o_orderdate apcadocdt, case o_orderpriority when '1-URGENT' then "
        "'01' when '2-HIGH' then '17' when '3-MEDIUM' then '19' when '5-LOW' then '29' else '99' end "
        'apca001, cast(o_custkey as string) apca004, case when o_orderkey % 3 = 0 then '
        "'GL-'||lpad(cast(o_orderkey as string),8,'0') end apca038, o_orderpriority apca053, case when "
        "o_orderstatus='P' then 'N' else 'Y' end apcastus from orders"
    ),
    "apcb_t": (
        "select case when l_orderkey % 50 = 0 then 100 else 666 end apcbent, 'AP-'||lpad(cast(l_orderkey "
        "as string),8,'0') apcbdocno, l_linestatus apcb002, case when l_partkey % 10 = 0 then "
        "cast(l_partkey as string) else lpad(cast(l_partkey as string),8,'0') end apcb004, l_returnflag "
        "apcb005, cast(l_quantity as decimal(18,2)) apcb007, cast(case when l_returnflag='R' then -1 else "
        '1 end as int) apcb022, cast(l_suppkey as string) apcb028, cast(l_extendedprice as decimal(18,2)) '
        'apcb101, cast(l_extendedprice as decimal(18,2)) apcb103, cast(l_tax as decimal(18,2)) apcb104, '
        'cast(l_extendedprice as decimal(18,2)) apcb105 from lineitem'
    ),
    "glacl_t": (
        "select * from (values ('6100','en_US','Salaries'),('6100','zh_TW','Salaries "
        "zh'),('6200','zh_TW',null),('6200','en_US','Rent'),('7100','en_US',null)) "
        't(glacl002,glacl003,glacl004)'
    ),
    "glap_t": (
        "select 'GL-'||lpad(cast(o_orderkey as string),8,'0') glapdocno, o_orderdate glapdocdt, case when "
        "o_orderstatus='P' then 'N' else 'S' end glapstus from orders"
    ),
    "glaq_t": (
        "select 'GL-'||lpad(cast(l_orderkey as string),8,'0') glaqdocno, l_returnflag||l_linestatus "
        "glaq001, case l_linenumber % 4 when 0 then '6100' when 1 then '6200 ' when 2 then '7100' else "
        "'1100' end glaq002, cast(l_extendedprice as decimal(18,2)) glaq003, cast(0 as decimal(18,2)) "
        'glaq004, cast(l_suppkey % 25 as string) glaq018 from lineitem'
    ),
    "imaal_t": (
        'select 666 imaalent, case when p_partkey % 10 = 0 then cast(p_partkey as string) else '
        "lpad(cast(p_partkey as string),8,'0') end imaal001, lang imaal002, p_name||'/'||lang imaal003, "
        "p_type imaal004 from part cross join (select * from (values ('en_US'),('zh_TW')) t(lang)) lg"
    ),
    "inba_t": (
        'select case when o_orderkey % 50 = 0 then 100 else 666 end inbaent, case o_orderkey % 4 when 0 '
        "then 'TS-IN010-' when 1 then 'TS-IN020-' when 2 then 'TS-IN999-' else 'TS-IN500-' "
        "end||lpad(cast(o_orderkey as string),8,'0') inbadocno, case when o_orderkey % 3 = 0 then '2' "
        "else '1' end inba001, o_orderdate inba002, cast(o_custkey % 100 + 1 as string) inba003, "
        'cast(o_custkey % 25 as string) inba004, case when o_orderkey % 5 = 0 then null else '
        "o_orderpriority end inba008, case when o_orderstatus='P' then 'X' else o_orderstatus end "
        'inbastus from orders'
    ),
    "inbb_t": (
        'select case when l_orderkey % 50 = 0 then 100 else 666 end inbbent, case l_orderkey % 4 when 0 '
        "then 'TS-IN010-' when 1 then 'TS-IN020-' when 2 then 'TS-IN999-' else 'TS-IN500-' "
        "end||lpad(cast(l_orderkey as string),8,'0') inbbdocno, case when l_partkey % 10 = 0 then "
        "cast(l_partkey as string) else lpad(cast(l_partkey as string),8,'0') end inbb001, 'PCS' inbb010, "
        'cast(l_quantity as decimal(18,2)) inbb012, l_returnflag inbb016, case when l_linenumber=1 then '
        'null else l_linestatus end inbb020 from lineitem'
    ),
    "isaf_t": (
        "select case when o_orderkey % 50 = 0 then 100 else 666 end isafent, 'IS-'||lpad(cast(o_orderkey "
        "as string),8,'0') isafdocno, cast(o_custkey as string) isaf002, case o_orderkey % 10 when 0 then "
        "'F' when 1 then 'CN' else 'IV' end||lpad(cast(o_orderkey as string),8,'0') isaf011, o_orderdate "
        "isaf014, 'TAX'||cast(o_custkey as string) isaf021, 'Buyer '||cast(o_custkey as string) isaf022, "
        "case when o_orderkey % 2 = 0 then 'USD' else 'THB' end isaf100, cast(case when o_orderkey % 2 = "
        "0 then 35.5 else 1 end as decimal(10,4)) isaf101, case when o_orderstatus='P' then 'N' else 'Y' "
        'end isafstus from orders'
    ),
    "isag_t": (
        "select case when l_orderkey % 50 = 0 then 100 else 666 end isagent, 'IS-'||lpad(cast(l_orderkey "
        "as string),8,'0') isagdocno, 'SH-'||lpad(cast(l_orderkey as string),8,'0') isag002, "
        'cast(l_quantity as decimal(18,2)) isag004, case when l_partkey % 10 = 0 then cast(l_partkey as '
        "string) else lpad(cast(l_partkey as string),8,'0') end isag009, 'waste '||l_returnflag isag010, "
        "'RT-'||lpad(cast(l_orderkey as string),8,'0') isag014, l_linestatus isag016, 'goods "
        "'||l_returnflag isag017, 'SO-'||lpad(cast(l_orderkey as string),8,'0') isag019, cast(l_discount "
        'as decimal(18,2)) isag101, cast(l_extendedprice as decimal(18,2)) isag103, cast(l_tax as '
        'decimal(18,2)) isag104, cast(l_extendedprice as decimal(18,2)) isag105 from lineitem'
    ),
    "ooag_t": (
        'select 666 ooagent, cast(s_suppkey as string) ooag001, cast(s_nationkey as string) ooag003, '
        's_name ooag011 from supplier'
    ),
    "oocql_t": (
        "select 666 oocqlent, cat oocql001, code oocql002, lang oocql003, code||'/'||cat||'/'||lang "
        "oocql004 from (select * from (values ('A'),('N'),('R')) c(code)) c cross join (select * from "
        "(values ('216'),('300')) g(cat)) g cross join (select * from (values ('en_US'),('zh_TW')) "
        't(lang)) lg'
    ),
    "ooefl_t": (
        'select 666 ooeflent, cast(n_nationkey as string) ooefl001, lang ooefl002, n_name ooefl003, '
        "n_name||'/'||lang ooefl004 from nation cross join (select * from (values ('en_US'),('zh_TW')) "
        't(lang)) lg'
    ),
    "oofa_t": (
        'select 666 oofaent, cast(s_suppkey as string) oofa003, s_name oofa011 from supplier'
    ),
    "oofb_t": (
        'select 666 oofbent, cast(c_custkey as string) oofb019, c_mktsegment oofb011 from customer'
    ),
    "ooff_t": (
        "select 'aint301' ooff002, case l_orderkey % 4 when 0 then 'TS-IN010-' when 1 then 'TS-IN020-' "
        "when 2 then 'TS-IN999-' else 'TS-IN500-' end||lpad(cast(l_orderkey as string),8,'0') ooff003, "
        "l_linenumber ooff004, 'note '||l_returnflag ooff013 from lineitem"
    ),
    "ooibl_t": (
        "select 666 ooiblent, p ooibl002, lang ooibl003, p||'/'||lang ooibl004 from (select distinct "
        "o_orderpriority p from orders) d cross join (select * from (values ('en_US'),('zh_TW')) t(lang)) "
        'lg'
    ),
    "pmaa_t": (
        'select 666 pmaaent, cast(c_custkey as string) pmaa001, case c_nationkey % 8 when 0 then null '
        "when 1 then 'NULL' when 2 then 'R0001' when 3 then 'R0002' when 4 then 'R0003' when 5 then "
        "'R0006' when 6 then 'R0007' else 'R0099' end pmaa006 from customer"
    ),
    "pmaal_t": (
        "select 666 pmaalent, cast(c_custkey as string) pmaal001, lang pmaal002, c_name||'/'||lang "
        "pmaal004 from customer cross join (select * from (values ('en_US'),('zh_TW')) t(lang)) lg where "
        'c_custkey % 7 <> 0'
    ),
    "pmao_t": (
        'select distinct 666 pmaoent, cast(o_custkey as string) pmao001, case when l_partkey % 10 = 0 '
        "then cast(l_partkey as string) else lpad(cast(l_partkey as string),8,'0') end pmao002, "
        "l_linestatus pmao004, 'CP-'||cast(l_partkey as string) pmao009, 'cust part '||cast(l_partkey as "
        'string) pmao010 from lineitem join orders on l_orderkey=o_orderkey where l_partkey % 3 <> 0'
    ),
    "xcbl_t": (
        "select 'C1' xcblcomp, 'L1' xcblld, 'T'||o_orderstatus xcbl001, cast(year(o_orderdate) as int) "
        "xcbl002, cast(month(o_orderdate) as int) xcbl003, 'AP-'||lpad(cast(o_orderkey as string),8,'0') "
        "xcbl004, o_orderpriority xcbl005, case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' "
        'end xcbl010, cast(o_custkey % 25 as string) xcbl012, cast(o_totalprice as decimal(18,2)) xcbl100 '
        'from orders'
    ),
    "xcea_t": (
        "select case when o_orderkey % 10 = 0 then 'XC090-' else 'XC-' end||lpad(cast(o_orderkey as "
        "string),8,'0') xceadocno, cast(year(o_orderdate) as int) xcea004, cast(month(o_orderdate) as "
        "int) xcea005, case when o_orderkey % 7 <> 3 then 'GL-'||lpad(cast(o_orderkey as string),8,'0') "
        'end xcea101 from orders'
    ),
    "xceb_t": (
        "select case when l_orderkey % 10 = 0 then 'XC090-' else 'XC-' end||lpad(cast(l_orderkey as "
        "string),8,'0') xcebdocno, case l_orderkey % 4 when 0 then 'TS-IN010-' when 1 then 'TS-IN020-' "
        "when 2 then 'TS-IN999-' else 'TS-IN500-' end||lpad(cast(l_orderkey as string),8,'0') xceb001, "
        'l_linenumber xceb002, case when l_partkey % 10 = 0 then cast(l_partkey as string) else '
        "lpad(cast(l_partkey as string),8,'0') end xceb004, trim(case l_linenumber % 4 when 0 then '6100' "
        "when 1 then '6200 ' when 2 then '7100' else '1100' end) xceb101, cast(l_suppkey % 25 as string) "
        'xceb108, l_returnflag xceb110, cast(l_quantity as decimal(18,2)) xceb201, cast(l_extendedprice '
        'as decimal(18,2)) xceb202 from lineitem'
    ),
    "xcec_t": (
        "select case when l_orderkey % 10 = 0 then 'XC090-' else 'XC-' end||lpad(cast(l_orderkey as "
        "string),8,'0') xcecdocno, case l_orderkey % 4 when 0 then 'TS-IN010-' when 1 then 'TS-IN020-' "
        "when 2 then 'TS-IN999-' else 'TS-IN500-' end||lpad(cast(l_orderkey as string),8,'0') xcec001, "
        'l_linenumber xcec002, case when l_partkey % 10 = 0 then cast(l_partkey as string) else '
        "lpad(cast(l_partkey as string),8,'0') end xcec004, trim(case l_linenumber % 4 when 0 then '6100' "
        "when 1 then '6200 ' when 2 then '7100' else '1100' end) xcec101, cast(l_suppkey % 25 as string) "
        'xcec108, l_returnflag xcec110, cast(l_quantity as decimal(18,2)) xcec201, cast(l_extendedprice '
        'as decimal(18,2)) xcec202 from lineitem'
    ),
    "xmda_t": (
        "select 'SO-'||lpad(cast(o_orderkey as string),8,'0') xmdadocno, 'PO-'||cast(o_custkey as string) "
        'xmda033 from orders'
    ),
    "xmdg_t": (
        "select case when o_orderkey % 50 = 0 then 100 else 666 end xmdgent, 'SN-'||lpad(cast(o_orderkey "
        "as string),8,'0') xmdgdocno, o_orderdate xmdgdocdt, cast(o_custkey % 100 + 1 as string) xmdg002, "
        'cast(o_custkey % 25 as string) xmdg003, cast(o_custkey as string) xmdg005, o_orderpriority '
        "xmdg008, case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end xmdg009, "
        'cast(o_custkey as string) xmdg017, o_orderdate + interval 2 day xmdg028, case o_orderstatus when '
        "'P' then 'X' when 'F' then 'Y' else 'H' end xmdgstus from orders"
    ),
    "xmdh_t": (
        "select case when l_orderkey % 50 = 0 then 100 else 666 end xmdhent, 'SN-'||lpad(cast(l_orderkey "
        "as string),8,'0') xmdhdocno, 'SO-'||lpad(cast(l_orderkey as string),8,'0') xmdh001, case when "
        "l_partkey % 10 = 0 then cast(l_partkey as string) else lpad(cast(l_partkey as string),8,'0') end "
        "xmdh006, case l_linenumber % 3 when 0 then null when 1 then 'BAG '||cast(cast(l_quantity as int) "
        "as string)||'KG 2' else 'LOOSE' end xmdh015, cast(l_quantity as decimal(18,2)) xmdh016, "
        'cast(l_quantity as decimal(18,2)) xmdh017, l_returnflag xmdh023, l_linestatus xmdh034 from '
        'lineitem'
    ),
    "xmdk_t": (
        "select 666 xmdkent, 'SH-'||lpad(cast(o_orderkey as string),8,'0') xmdkdocno, o_orderdate + "
        "interval 3 day xmdk001, 'SN-'||lpad(cast(o_orderkey as string),8,'0') xmdk005, "
        "'SO-'||lpad(cast(o_orderkey as string),8,'0') xmdk006 from orders union all select 666, "
        "'SX-'||lpad(cast(o_orderkey as string),8,'0'), o_orderdate + interval 4 day, "
        "'SN-'||lpad(cast(o_orderkey as string),8,'0'), 'SO-'||lpad(cast(o_orderkey as string),8,'0') "
        'from orders where o_orderkey % 4 = 0'
    ),
    "xmdl_t": (
        "select case when o_orderkey % 50 = 0 then 100 else 666 end xmdlent, 'SH-'||lpad(cast(o_orderkey "
        "as string),8,'0') xmdldocno, 'SN-'||lpad(cast(o_orderkey as string),8,'0') xmdl001, "
        "'SO-'||lpad(cast(o_orderkey as string),8,'0') xmdl003 from orders"
    ),
    "xrce_t": (
        "select 'F'||lpad(cast(l_orderkey as string),8,'0') xrce054, case when l_linenumber = 2 then null "
        "else l_returnflag end xrce003, 'RC-'||lpad(cast(l_orderkey as "
        "string),8,'0')||'-'||cast(l_linenumber as string) xrcedocno from lineitem where l_orderkey % 10 "
        '= 0'
    ),
}
