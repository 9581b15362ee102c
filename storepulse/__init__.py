"""storepulse: store analytics (metrics, bonus, deals, maintenance) as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame``; nothing is collected on the driver.
"""

__version__ = "0.1.0"
