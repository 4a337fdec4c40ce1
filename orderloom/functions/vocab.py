"""Fixed values that results depend on."""

# Fixed value: what counts as an e-mail address.
EMAIL_PATTERN = r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# ISO 4217 codes that are recognised in text.
CURRENCY_CODES = (
    "USD", "EUR", "GBP", "INR", "CAD", "AUD", "JPY", "CNY", "CHF", "MXN",
    "SGD", "HKD", "SEK", "NOK", "DKK", "NZD", "ZAR", "BRL", "AED", "KRW",
)

# Signs that stand for one currency only, in order of search.
CURRENCY_SYMBOLS = {"€": "EUR", "£": "GBP", "₹": "INR"}

# English month names and their usual short forms.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4,
    "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

# Labels of order header fields, regular expressions in order of preference at equal length.
HEADER_LABELS = (
    ("purchase_order_number", (
        r"purchase\s+order\s+(?:number|no\.?|num\.?|#)", r"p\.?\s?o\.?\s+(?:number|no\.?|num\.?|#)", r"p\.?\s?o\.?\s*#",
        r"order\s+(?:number|no\.?|num\.?|#)", r"purchase\s+order", r"po",
    )),
    ("order_date", (
        r"(?:purchase\s+)?order\s+date", r"p\.?\s?o\.?\s+date", r"date\s+of\s+order", r"issue\s+date", r"date\s+issued", r"date",
    )),
    ("requested_delivery_date", (
        r"requested\s+delivery\s+date", r"required\s+delivery\s+date", r"requested\s+ship\s+date", r"delivery\s+date",
        r"need[\s-]+by(?:\s+date)?", r"required\s+(?:by|date)", r"deliver\s+by", r"due\s+date",
    )),
    ("currency", (r"currency(?:\s+code)?",)),
    ("supplier_name", (r"supplier(?:\s+name)?", r"vendor(?:\s+name)?", r"sold\s+by", r"seller")),
    ("supplier_email", (r"(?:supplier|vendor)\s+e-?mail(?:\s+address)?",)),
    ("supplier_address", (r"(?:supplier|vendor)\s+address",)),
    ("buyer_name", (r"buyer(?:\s+name)?", r"customer(?:\s+name)?", r"purchaser", r"ordered\s+by", r"issued\s+by")),
    ("buyer_address", (r"(?:buyer|customer|purchaser)\s+address",)),
    ("ship_to_address", (
        r"ship[\s-]+to(?:\s+address)?", r"deliver[\s-]+to", r"delivery\s+address", r"shipping\s+address", r"consignee",
    )),
    ("bill_to_address", (r"bill[\s-]+to(?:\s+address)?", r"invoice[\s-]+to", r"billing\s+address", r"invoice\s+address")),
    ("payment_terms", (r"payment\s+terms", r"terms\s+of\s+payment", r"payment\s+conditions", r"terms")),
    ("shipping_terms", (
        r"inco\s?terms?", r"shipping\s+terms", r"delivery\s+terms", r"freight\s+terms", r"terms\s+of\s+delivery",
    )),
    ("subtotal", (r"sub[\s-]?total", r"net\s+(?:amount|total|value)", r"total\s+net", r"merchandise\s+total", r"goods\s+total")),
    ("tax", (r"(?:sales\s+)?tax(?:\s+amount)?", r"total\s+tax", r"vat", r"gst", r"hst")),
    ("shipping", (
        r"shipping\s+(?:&|and)\s+handling", r"shipping(?:\s+(?:charges?|cost|fee))?", r"freight(?:\s+(?:charges?|cost))?",
        r"delivery\s+charges?", r"carriage", r"s\s?&\s?h",
    )),
    ("total_amount", (
        r"grand\s+total", r"total\s+amount(?:\s+due)?", r"order\s+total", r"po\s+total", r"total\s+(?:due|value|price)",
        r"amount\s+due", r"gross\s+(?:amount|total)", r"total",
    )),
)

# Fields by the kind of their values.
PARTY_FIELDS = ("supplier_name", "buyer_name")
ADDRESS_FIELDS = ("supplier_address", "buyer_address", "ship_to_address", "bill_to_address")
MONEY_FIELDS = ("subtotal", "tax", "shipping", "total_amount")
DATE_FIELDS = ("order_date", "requested_delivery_date")

# Headings of line-item columns, matched against the whole cell.
ITEM_COLUMNS = (
    ("line_number", (
        r"line(?:\s+(?:no\.?|number|#))?", r"ln", r"pos\.?", r"position", r"#", r"no\.?", r"s\.?\s?no\.?", r"sr\.?\s?no\.?",
    )),
    ("part_number", (
        r"part\s*(?:number|no\.?|num\.?|#)", r"part", r"item\s*(?:number|no\.?|code|#|id)", r"sku",
        r"material(?:\s+(?:number|no\.?|code))?", r"product\s*(?:code|number|no\.?|id)", r"article(?:\s+(?:no\.?|number))?",
        r"catalog(?:ue)?\s*(?:number|no\.?|#)", r"mfr\.?\s*part(?:\s*(?:no\.?|number|#))?",
    )),
    ("part_name", (
        r"(?:item\s+|part\s+|product\s+)?description", r"part\s+name", r"item\s+name", r"product(?:\s+name)?",
        r"material\s+description", r"details",
    )),
    ("quantity", (r"qty\.?(?:\s+ordered)?", r"quantity(?:\s+ordered)?", r"order(?:ed)?\s+qty\.?", r"units")),
    ("unit_of_measure", (r"uom", r"u/m", r"unit\s+of\s+measure", r"unit", r"um")),
    ("unit_price", (r"unit\s+(?:price|cost)", r"price(?:\s+per\s+unit)?", r"rate", r"unit\s+rate", r"cost")),
    ("line_total", (
        r"line\s+total", r"(?:net\s+|extended\s+|ext\.?\s+|line\s+)?amount", r"ext(?:ended|\.)?\s+price",
        r"total(?:\s+price)?", r"net\s+value", r"value",
    )),
    ("requested_delivery_date", (
        r"(?:requested\s+)?delivery\s+date", r"need[\s-]+by(?:\s+date)?", r"due\s+date", r"required\s+date",
        r"(?:requested\s+)?ship\s+date", r"delivery",
    )),
)
# Fixed value: the heading that may mean a number, a part or a description.
ITEM_HEADING = r"item"

# Fixed value: endings of company names.
COMPANY_SUFFIX = (
    r"(?:inc|incorporated|ltd|limited|llc|l\.l\.c|corp|corporation|co|company|gmbh|ag|plc|s\.?r\.?l|s\.?a|b\.?v|n\.?v"
    r"|pvt\.?\s+ltd|pty\.?\s+ltd|kg|oy|ab|as|sas|spa|s\.p\.a)\.?"
)

# Texts of warnings and of evidence without a place.
LETTERHEAD_WARNING = "buyer_name taken from document letterhead (no explicit buyer label)"
DOLLAR_WARNING = "currency symbol '$' found but ambiguous (USD/CAD/AUD...); currency left empty"
MISSING_WARNING = "not found in document"
NUMBERS_WARNING = "line numbers not present in document; assigned sequentially by row order"
NO_ITEMS_WARNING = "no line items found"
BODY_CURRENCY = "currency code/symbol found in document body"

# States in their order, those that are done, and all that end the work on a mail or document.
STAGES = ("RECEIVED", "EMAIL_PARSED", "DOCUMENT_DOWNLOADED", "DOCUMENT_PARSED", "EXTRACTED", "VALIDATED", "SAVED")
DONE = ("SAVED", "DUPLICATE", "IGNORED")
FINAL = (*DONE, "FAILED")

# Errors that no repetition mends.
PERMANENT_ERRORS = (
    "EmailNotFoundError", "MalformedEmailError", "AttachmentNotFoundError", "DocumentParseError", "ExtractionError", "PurchaseOrderValidationError",
)

# Texts of events and of statuses.
NEW_MAIL, DONE_MAIL, MAIL_AGAIN = "email received", "delivered again after it was finished", "taken again as it was not finished"
NEW_FILE, DONE_FILE, FILE_AGAIN = "file downloaded", "file is already document", "file taken again as it was not finished"
NO_PDF = "no PDF attachment found"

# Messages of errors in validated orders, by rule; of required fields by field.
ISSUE_MESSAGES = {
    "no_part": "line item has neither part number nor description", "missing": "quantity is missing", "not_positive": "quantity must be positive", "negative": "unit price must not be negative",
}
REQUIRED_MESSAGES = {"po_number": "PO number is required", "line_items": "at least one line item is required"}
