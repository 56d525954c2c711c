"""ledgerframe: ERP reporting jobs as lazily planned Spark DataFrames.

Public entry points:

* reports: ``report_gl_expense_vouchers``, ``report_misc_issue_lines``, ``report_cost_ledger``,
  ``report_issue_cost_by_dept``, ``report_issue_cost_by_account``, ``report_order_fulfilment``,
  ``report_tax_invoice``, ``report_tax_invoice_by_price``, ``report_ap_invoices``;
* parameters: ``MonthParam``, ``DateRange``;
* sources: ``read_erp_lake``, ``read_erp_jdbc``, ``write_erp_lake``;
* sinks: ``rows_as_arrays``, ``rows_as_objects``, ``write_json_rows``, ``write_labelled_csv``,
  ``with_row_count``;
* session: ``build_session``.
"""

from .params import DateRange, MonthParam, ParameterError
from .plans.costing import report_cost_ledger, report_issue_cost_by_account, report_issue_cost_by_dept
from .plans.gl import report_gl_expense_vouchers
from .plans.inventory import report_misc_issue_lines
from .plans.payables import report_ap_invoices
from .plans.sales import report_order_fulfilment, report_tax_invoice, report_tax_invoice_by_price
from .session import build_session
from .sinks import rows_as_arrays, rows_as_objects, with_row_count, write_json_rows, write_labelled_csv
from .sources.loaders import read_erp_jdbc, read_erp_lake, write_erp_lake

__all__ = [
    "DateRange", "MonthParam", "ParameterError", "build_session",
    "read_erp_jdbc", "read_erp_lake", "write_erp_lake", "report_ap_invoices", "report_cost_ledger",
    "report_gl_expense_vouchers", "report_issue_cost_by_account", "report_issue_cost_by_dept",
    "report_misc_issue_lines", "report_order_fulfilment", "report_tax_invoice", "report_tax_invoice_by_price",
    "rows_as_arrays", "rows_as_objects", "with_row_count", "write_json_rows", "write_labelled_csv",
]
