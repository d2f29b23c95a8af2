"""Aliases of the canonical list of industries and occupations, as a table for problem 7. The operator takes any table of this form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Aliases of industries.
INDUSTRIES = {
    "Oil, Gas and Pipelines": ("oil and gas", "petroleum", "natural gas", "fossil fuel extraction"),
    "Electric Utilities": ("utilities electric", "power companies", "electricity supply"),
    "Renewable Power": ("wind and solar", "clean energy", "green power"),
    "Commercial Banking": ("banks", "banking", "bank holding"),
    "Hedge Funds and Private Equity": ("private equity", "pe hedge", "investment funds", "hedge funds"),
    "Insurance Carriers": ("insurers", "insurance cos", "underwriters", "insurance"),
    "Real Estate Development": ("real estate", "property development", "realtors and developers"),
    "Hospitals and Clinics": ("hospital systems", "health facilities", "clinics", "hospitals"),
    "Physicians and Nurses": ("doctors", "nursing", "medical professionals"),
    "Drug Makers": ("pharma", "pharmaceutical mfg", "prescription drugs", "pharmaceuticals"),
    "Defense Contracting": ("military contractors", "arms makers", "defence", "defense"),
    "Aviation and Airports": ("airlines", "airport ops", "air transport"),
    "Railroads and Trucking": ("trucking", "rail and freight", "surface freight", "railroads"),
    "Crop Farming": ("farm production", "growers", "row crops"),
    "Livestock and Dairy": ("cattle dairy", "ranching", "meat and milk"),
    "Timber and Paper": ("forestry", "logging", "pulp mills"),
    "Construction Trades": ("builders", "building contractors", "general contractors"),
    "Software and Internet": ("tech", "information technology", "web platforms"),
    "Telephone and Cable": ("telecom", "cable tv", "broadband carriers"),
    "Film, Music and Broadcasting": ("entertainment", "movies and music", "radio tv"),
    "Law Practice": ("law firms", "legal services", "attorneys"),
    "Lobbying and Public Affairs": ("lobbyists", "government relations", "govt affairs"),
    "Higher Education": ("universities", "colleges", "postsecondary"),
    "School Teachers": ("teachers unions", "classroom educators", "k 12 educators"),
    "Public Employees": ("civil servants", "government workers", "state and municipal employees"),
    "Gaming and Casinos": ("casino operators", "gambling", "sportsbooks"),
    "Beer, Wine and Spirits": ("distillers", "alcohol", "beverage alcohol"),
    "Retail Stores": ("retailers", "merchants", "shopping"),
    "Mining and Minerals": ("miners", "quarrying", "metals mining"),
    "Environmental Advocacy": ("environmentalists", "conservation groups", "ecology orgs"),
}
#: Aliases of occupations.
OCCUPATIONS = {
    "Attorney": ("lawyer", "atty", "attorney at law", "counsel", "esquire"), "Physician": ("md", "doctor", "medical doctor", "surgeon physician"),
    "Registered Nurse": ("rn", "nurse", "staff nurse"), "Dentist": ("dds", "dental surgeon"), "Pharmacist": ("druggist", "pharmd"),
    "Accountant": ("cpa", "bookkeeper cpa", "certified public accountant"), "Teacher": ("educator", "k 12 teacher", "school teacher"),
    "Professor": ("prof", "college professor", "university faculty"), "Software Engineer": ("swe", "programmer", "coder", "software developer"),
    "Civil Engineer": ("structural civil eng", "engineer civil"), "Electrician": ("journeyman electrician", "electrical worker"),
    "Plumber": ("plumbing", "pipefitter plumber"), "Carpenter": ("finish carpenter", "woodworker carpenter"),
    "Truck Driver": ("cdl driver", "trucker", "teamster driver"), "Airline Pilot": ("pilot", "commercial pilot", "capt airline"),
    "Farmer": ("agricultural producer", "farm owner", "grower"), "Rancher": ("cattle rancher", "cattleman"),
    "Real Estate Broker": ("realtor", "re broker", "real estate agent"), "Insurance Agent": ("ins agt", "insurance broker", "insurance sales"),
    "Banker": ("bank officer", "bank exec"), "Financial Advisor": ("financial planner", "wealth manager", "investment adviser"),
    "Chief Executive Officer": ("ceo", "president ceo", "c e o"), "Chief Financial Officer": ("cfo", "finance chief", "c f o"),
    "Business Owner": ("proprietor", "small business owner", "owner operator"), "Consultant": ("mgmt consultant", "independent consultant"),
    "Lobbyist": ("government relations", "govt affairs"), "Journalist": ("reporter", "news editor", "newspaper writer"),
    "Architect": ("aia architect", "bldg architect"), "Veterinarian": ("dvm", "animal doctor", "vet"), "Police Officer": ("cop", "patrolman", "law enforcement"),
    "Firefighter": ("fireman", "fire dept"), "Social Worker": ("lcsw", "msw", "case worker"), "Librarian": ("library director", "library sci"),
    "Psychologist": ("psychotherapist", "clinical psych"), "Chef": ("head cook", "executive chef"), "Restaurant Owner": ("restaurateur", "restaurant operator"),
    "Salesperson": ("salesman", "sales rep", "account executive sales"), "Retired": ("ret", "retd", "retiree", "pensioner"),
    "Homemaker": ("housewife", "stay at home parent"), "Not Employed": ("unemployed", "out of work", "none not working"),
    "Student": ("college student", "grad student"), "Clergy": ("pastor", "minister", "rabbi"), "Scientist": ("research scientist", "researcher science"),
    "Graphic Designer": ("visual designer",), "Mechanic": ("auto mechanic", "auto technician"), "Machinist": ("cnc machinist", "tool and die"),
    "Welder": ("pipe welder", "welding"), "Actor": ("actress", "stage actor"), "Musician": ("violinist", "band musician"), "Author": ("novelist", "book author"),
    "Investor": ("private investor", "venture investor"), "Judge": ("jurist", "magistrate"), "Legislator": ("lawmaker", "state rep"),
    "Paralegal": ("legal assistant", "law clerk paralegal"), "Administrative Assistant": ("secretary", "office assistant", "admin asst"),
    "Human Resources Manager": ("hr manager", "hr director", "personnel mgr"), "Physical Therapist": ("pt", "physiotherapist"),
    "Optometrist": ("od", "eye doctor", "od eye doctor"), "Bus Driver": ("transit operator", "school bus driver"),
    "Longshore Worker": ("longshoreman", "dock worker"), "Steelworker": ("steel worker", "mill hand steel"),
}


def table(spark: SparkSession) -> DataFrame:
    """kind, label, alias."""
    rows = [(kind, label, alias) for kind, names in (("industry", INDUSTRIES), ("occupation", OCCUPATIONS)) for label, found in names.items() for alias in found]
    return spark.createDataFrame(rows, "kind string, label string, alias string")
