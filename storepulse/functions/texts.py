"""The report and message texts the reference shows, as format
strings (``%s`` / ``%d`` placeholders, in the order the values appear)."""

# Store report lines.
PURCHASES_LINE = "Purchases per minute (from %s to %s): %s"
REVENUE_LINE = "Revenue per minute (from %s to %s): $%s"
UNIQUE_USERS_HEADER = "Unique Users (from %s to %s):"
UNIQUE_USERS_LINE = "#%d: Product %s: %d unique users"
MOST_VIEWED_HEADER = "Most Viewed Products (from %s to %s):"
MOST_VIEWED_LINE = "#%d: Product %s: %d views"
MEDIAN_LINE = "The median of the views before buying is %d (from %d to %d, with a sum of %d views)"
WITHOUT_STOCK_LINE = "Products Sold Without Stock: %s units"

# Deal answer lines.
DEALS_HEADER = "Showing offers in the period of %d months with %s%% of discount (at %s):"
DEAL_LINE = ' - Product "%s" (ID %s): from $%s to $%s (%s%% of discount) in store %s'
NO_DEALS = "No deals found."

# Fixed value: a report section without data.
NO_DATA = "No data available."

# Coupon line.
COUPON_LINE = "========= USER %s OF STORE %s GOT A COUPON ========="

# A product name that is missing prints as Python's None.
MISSING_NAME = "None"

# Why a deal request is rejected.
NO_REQUEST = "no valid request"
NO_DISCOUNT = "the discount is not above 0"
NO_PERIOD = "the period does not start at a date"
