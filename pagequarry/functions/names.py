"""Company names as data."""

from __future__ import annotations

#: Names of one company, and the entity they stand for.
ALIASES = {
    "infosys": "Infosys",
    "infosys limited": "Infosys",
    "infosys ltd": "Infosys",
    "tcs": "TCS",
    "tata consultancy services": "TCS",
    "tata consultancy services limited": "TCS",
}

#: Well-known companies, by their lower-case name, as they are printed.
KNOWN = {
    "wipro": "Wipro",
    "hcl": "HCL",
    "hcl technologies": "HCL Technologies",
    "hcltech": "HCLTech",
    "tech mahindra": "Tech Mahindra",
    "ltimindtree": "LTIMindtree",
    "l&t infotech": "L&T Infotech",
    "mindtree": "Mindtree",
    "mphasis": "Mphasis",
    "coforge": "Coforge",
    "persistent systems": "Persistent Systems",
    "zensar": "Zensar",
    "birlasoft": "Birlasoft",
    "cyient": "Cyient",
    "kpit": "KPIT",
    "accenture": "Accenture",
    "cognizant": "Cognizant",
    "capgemini": "Capgemini",
    "ibm": "IBM",
    "dxc": "DXC",
    "dxc technology": "DXC Technology",
    "genpact": "Genpact",
    "epam": "EPAM",
    "globant": "Globant",
    "atos": "Atos",
    "ntt data": "NTT Data",
    "deloitte": "Deloitte",
    "pwc": "PwC",
    "kpmg": "KPMG",
    "ernst & young": "Ernst & Young",
    "mckinsey": "McKinsey",
    "reliance": "Reliance",
    "reliance industries": "Reliance Industries",
    "ril": "RIL",
    "tata motors": "Tata Motors",
    "tata steel": "Tata Steel",
    "tata power": "Tata Power",
    "titan": "Titan",
    "adani": "Adani",
    "adani enterprises": "Adani Enterprises",
    "adani ports": "Adani Ports",
    "bharti airtel": "Bharti Airtel",
    "airtel": "Airtel",
    "jio": "Jio",
    "vodafone idea": "Vodafone Idea",
    "itc": "ITC",
    "hindustan unilever": "Hindustan Unilever",
    "hul": "HUL",
    "nestle india": "Nestlé India",
    "maruti": "Maruti",
    "maruti suzuki": "Maruti Suzuki",
    "mahindra & mahindra": "Mahindra & Mahindra",
    "larsen & toubro": "Larsen & Toubro",
    "l&t": "L&T",
    "asian paints": "Asian Paints",
    "ultratech": "UltraTech",
    "sun pharma": "Sun Pharma",
    "dr reddy's": "Dr Reddy's",
    "cipla": "Cipla",
    "divi's laboratories": "Divi's Laboratories",
    "bajaj finance": "Bajaj Finance",
    "bajaj finserv": "Bajaj Finserv",
    "jsw steel": "JSW Steel",
    "coal india": "Coal India",
    "ongc": "ONGC",
    "hdfc": "HDFC",
    "hdfc bank": "HDFC Bank",
    "icici": "ICICI",
    "icici bank": "ICICI Bank",
    "axis bank": "Axis Bank",
    "state bank of india": "State Bank of India",
    "sbi": "SBI",
    "kotak mahindra bank": "Kotak Mahindra Bank",
    "kotak": "Kotak",
    "indusind bank": "IndusInd Bank",
    "yes bank": "Yes Bank",
    "punjab national bank": "Punjab National Bank",
    "pnb": "PNB",
    "bank of baroda": "Bank of Baroda",
    "canara bank": "Canara Bank",
    "idfc first bank": "IDFC First Bank",
    "au small finance bank": "AU Small Finance Bank",
    "paytm": "Paytm",
    "one97": "One97",
    "zerodha": "Zerodha",
    "bajaj housing finance": "Bajaj Housing Finance",
    "microsoft": "Microsoft",
    "google": "Google",
    "alphabet": "Alphabet",
    "amazon": "Amazon",
    "apple": "Apple",
    "meta": "Meta",
    "facebook": "Facebook",
    "oracle": "Oracle",
    "sap": "SAP",
    "salesforce": "Salesforce",
    "nvidia": "NVIDIA",
    "intel": "Intel",
    "tesla": "Tesla",
    "netflix": "Netflix",
    "samsung": "Samsung",
    "adobe": "Adobe",
    "cisco": "Cisco",
    "dell": "Dell",
    "hp": "HP",
    "hewlett packard": "Hewlett Packard",
}
