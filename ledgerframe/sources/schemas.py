"""Declared schemas of the 30 ERP tables the reports read (only the columns they touch).

The source database has no DDL in code; types are inferred from use: money and quantities are
``decimal(18,2)``, periods and tenants ``int``, document dates ``timestamp_ntz`` (they carry a
time of day), codes and labels ``string``.
"""

from __future__ import annotations

ERP_SCHEMAS: dict[str, str] = {
    "apca_t": "apcaent int, apcadocno string, apcadocdt timestamp_ntz, apca001 string, apca004 string, "
    "apca038 string, apca053 string, apcastus string",
    "apcb_t": "apcbent int, apcbdocno string, apcb002 string, apcb004 string, apcb005 string, "
    "apcb007 decimal(18,2), apcb022 int, apcb028 string, apcb101 decimal(18,2), apcb103 decimal(18,2), "
    "apcb104 decimal(18,2), apcb105 decimal(18,2)",
    "glacl_t": "glacl002 string, glacl003 string, glacl004 string",
    "glap_t": "glapdocno string, glapdocdt timestamp_ntz, glapstus string",
    "glaq_t": "glaqdocno string, glaq001 string, glaq002 string, glaq003 decimal(18,2), "
    "glaq004 decimal(18,2), glaq018 string",
    "imaal_t": "imaalent int, imaal001 string, imaal002 string, imaal003 string, imaal004 string",
    "inba_t": "inbaent int, inbadocno string, inba001 string, inba002 timestamp_ntz, inba003 string, "
    "inba004 string, inba008 string, inbastus string",
    "inbb_t": "inbbent int, inbbdocno string, inbb001 string, inbb010 string, inbb012 decimal(18,2), "
    "inbb016 string, inbb020 string",
    "isaf_t": "isafent int, isafdocno string, isaf002 string, isaf011 string, isaf014 timestamp_ntz, "
    "isaf021 string, isaf022 string, isaf100 string, isaf101 decimal(10,4), isafstus string",
    "isag_t": "isagent int, isagdocno string, isag002 string, isag004 decimal(18,2), isag009 string, "
    "isag010 string, isag014 string, isag016 string, isag017 string, isag019 string, "
    "isag101 decimal(18,2), isag103 decimal(18,2), isag104 decimal(18,2), isag105 decimal(18,2)",
    "ooag_t": "ooagent int, ooag001 string, ooag003 string, ooag011 string",
    "oocql_t": "oocqlent int, oocql001 string, oocql002 string, oocql003 string, oocql004 string",
    "ooefl_t": "ooeflent int, ooefl001 string, ooefl002 string, ooefl003 string, ooefl004 string",
    "oofa_t": "oofaent int, oofa003 string, oofa011 string",
    "oofb_t": "oofbent int, oofb019 string, oofb011 string",
    "ooff_t": "ooff002 string, ooff003 string, ooff004 int, ooff013 string",
    "ooibl_t": "ooiblent int, ooibl002 string, ooibl003 string, ooibl004 string",
    "pmaa_t": "pmaaent int, pmaa001 string, pmaa006 string",
    "pmaal_t": "pmaalent int, pmaal001 string, pmaal002 string, pmaal004 string",
    "pmao_t": "pmaoent int, pmao001 string, pmao002 string, pmao004 string, pmao009 string, pmao010 string",
    "xcbl_t": "xcblcomp string, xcblld string, xcbl001 string, xcbl002 int, xcbl003 int, xcbl004 string, "
    "xcbl005 string, xcbl010 string, xcbl012 string, xcbl100 decimal(18,2)",
    "xcea_t": "xceadocno string, xcea004 int, xcea005 int, xcea101 string",
    "xceb_t": "xcebdocno string, xceb001 string, xceb002 int, xceb004 string, xceb101 string, "
    "xceb108 string, xceb110 string, xceb201 decimal(18,2), xceb202 decimal(18,2)",
    "xcec_t": "xcecdocno string, xcec001 string, xcec002 int, xcec004 string, xcec101 string, "
    "xcec108 string, xcec110 string, xcec201 decimal(18,2), xcec202 decimal(18,2)",
    "xmda_t": "xmdadocno string, xmda033 string",
    "xmdg_t": "xmdgent int, xmdgdocno string, xmdgdocdt timestamp_ntz, xmdg002 string, xmdg003 string, "
    "xmdg005 string, xmdg008 string, xmdg009 string, xmdg017 string, xmdg028 timestamp_ntz, xmdgstus string",
    "xmdh_t": "xmdhent int, xmdhdocno string, xmdh001 string, xmdh006 string, xmdh015 string, "
    "xmdh016 decimal(18,2), xmdh017 decimal(18,2), xmdh023 string, xmdh034 string",
    "xmdk_t": "xmdkent int, xmdkdocno string, xmdk001 timestamp_ntz, xmdk005 string, xmdk006 string",
    "xmdl_t": "xmdlent int, xmdldocno string, xmdl001 string, xmdl003 string",
    "xrce_t": "xrce054 string, xrce003 string, xrcedocno string",
}

# Document headers and the date the reports filter them by: stored range-clustered by it, so
# a pushed date range skips whole files and row groups by their min/max statistics.
DOCUMENT_DATES: dict[str, str] = {
    "apca_t": "apcadocdt",
    "glap_t": "glapdocdt",
    "inba_t": "inba002",
    "isaf_t": "isaf014",
    "xmdg_t": "xmdg028",
}

# Partition layout of a partitioned lake: headers by ``doc_month`` (yyyymm of their report
# date, a derived column), period tables by their own year and month columns. Reports filter on
# these, so a month report lists and reads only that month's folders.
DOC_MONTH = "doc_month"
# Lines of a partitioned lake carry the month of their header: (header table, its document number,
# the line's document number). A document number with headers of several months has a value of its own,
# and so has one without a dated header.
LINE_HEADERS: dict[str, tuple[str, str, str]] = {
    "apcb_t": ("apca_t", "apcadocno", "apcbdocno"),
    "glaq_t": ("glap_t", "glapdocno", "glaqdocno"),
    "inbb_t": ("inba_t", "inbadocno", "inbbdocno"),
    "isag_t": ("isaf_t", "isafdocno", "isagdocno"),
    "xmdh_t": ("xmdg_t", "xmdgdocno", "xmdhdocno"),
}
# Lines that a report also filters by another column: within a month (or file) they lie in its order, so
# a prefix filter skips row groups by their statistics.
FILTER_KEYS: dict[str, str] = {"glaq_t": "glaq002"}
SEVERAL_MONTHS = 0
NO_MONTH = -1
PERIOD_PARTITIONS: dict[str, list[str]] = {
    "xcbl_t": ["xcbl002", "xcbl003"],
    "xcea_t": ["xcea004", "xcea005"],
}

# Large tables without a report date, stored hash-clustered by the document key they are
# joined on (lines sit in the same file range as nothing else, and scans split evenly).
CLUSTER_KEYS: dict[str, str] = {
    "apcb_t": "apcbdocno",
    "glaq_t": "glaqdocno",
    "inbb_t": "inbbdocno",
    "isag_t": "isagdocno",
    "xmdh_t": "xmdhdocno",
    "xceb_t": "xcebdocno",
    "xcec_t": "xcecdocno",
    "xcea_t": "xceadocno",
    "xcbl_t": "xcbl004",
    "ooff_t": "ooff003",
    "xrce_t": "xrce054",
    "pmao_t": "pmao001",
    "xmda_t": "xmdadocno",
    "xmdk_t": "xmdk005",
    "xmdl_t": "xmdldocno",
}
