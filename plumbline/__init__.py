"""Plumbline: audits tables of source-repository files with Spark DataFrames.

Every rule is a function from a ``repo_files`` DataFrame to a DataFrame of
facts, findings or verdicts.  Work inside one file is done with column
expressions over that file's row, so most rules need no shuffle at all.
"""

from plumbline.policy import AuditPolicy

__all__ = ["AuditPolicy"]
