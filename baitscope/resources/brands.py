"""Brand dictionary: brand name -> official sender domains.

FIXED VALUES: the 50 brands and their domains, in dictionary order.  The
header operator derives its keyword table from this list (see
``baitscope.sources.brands``).
"""

BRANDS = [
    ("Google", ["google.com", "gmail.com", "youtube.com", "googleapis.com"]),
    ("Microsoft", ["microsoft.com", "outlook.com", "live.com", "office365.com", "office.com"]),
    ("Apple", ["apple.com", "icloud.com", "me.com"]),
    ("Amazon", ["amazon.com", "amazon.co.uk", "aws.amazon.com"]),
    ("PayPal", ["paypal.com", "paypal.me"]),
    ("Netflix", ["netflix.com"]),
    ("Facebook", ["facebook.com", "fb.com", "meta.com"]),
    ("Instagram", ["instagram.com"]),
    ("LinkedIn", ["linkedin.com"]),
    ("Twitter/X", ["twitter.com", "x.com"]),
    ("Chase", ["chase.com", "jpmorganchase.com"]),
    ("Wells Fargo", ["wellsfargo.com"]),
    ("Bank of America", ["bankofamerica.com", "bofa.com"]),
    ("Citibank", ["citibank.com", "citi.com"]),
    ("Capital One", ["capitalone.com"]),
    ("American Express", ["americanexpress.com", "amex.com"]),
    ("Dropbox", ["dropbox.com"]),
    ("Adobe", ["adobe.com"]),
    ("Salesforce", ["salesforce.com"]),
    ("Zoom", ["zoom.us"]),
    ("Slack", ["slack.com"]),
    ("GitHub", ["github.com"]),
    ("Yahoo", ["yahoo.com"]),
    ("WhatsApp", ["whatsapp.com"]),
    ("Telegram", ["telegram.org"]),
    ("Coinbase", ["coinbase.com"]),
    ("Binance", ["binance.com"]),
    ("Stripe", ["stripe.com"]),
    ("Shopify", ["shopify.com"]),
    ("eBay", ["ebay.com"]),
    ("Walmart", ["walmart.com"]),
    ("Target", ["target.com"]),
    ("Best Buy", ["bestbuy.com"]),
    ("Home Depot", ["homedepot.com"]),
    ("Costco", ["costco.com"]),
    ("FedEx", ["fedex.com"]),
    ("UPS", ["ups.com"]),
    ("USPS", ["usps.com"]),
    ("DHL", ["dhl.com"]),
    ("IRS", ["irs.gov"]),
    ("Social Security", ["ssa.gov"]),
    ("Medicare", ["medicare.gov"]),
    ("DocuSign", ["docusign.com", "docusign.net"]),
    ("Uber", ["uber.com"]),
    ("Lyft", ["lyft.com"]),
    ("Venmo", ["venmo.com"]),
    ("Cash App", ["cash.app", "squareup.com"]),
    ("T-Mobile", ["t-mobile.com"]),
    ("AT&T", ["att.com"]),
    ("Verizon", ["verizon.com"]),
]


def brand_keywords():
    """Keyword -> domains table, in first-insertion order.

    Each brand contributes its lower-case full name and every word of the name
    with at least three characters.  A keyword seen again keeps its first
    position but takes the later brand's domains.
    """
    order, table = [], {}
    for name, domains in BRANDS:
        lname = name.lower()
        doms = [d.lower() for d in domains]
        for kw in [lname] + [w for w in lname.split() if len(w) >= 3]:
            if kw not in table:
                order.append(kw)
            table[kw] = doms
    return [(i, kw, table[kw]) for i, kw in enumerate(order)]
