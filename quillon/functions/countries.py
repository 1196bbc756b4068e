"""The registry of countries: a fixed dimension of 118 rows, small enough to be sent to every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, Korean name, English name, continent and region of each country, in the registry's order.
COUNTRIES = """
KR|대한민국|South Korea|korea|Korea
NP|네팔|Nepal|asia|South Asia
TW|대만|Taiwan|asia|East Asia
TL|동티모르|Timor-Leste|asia|Southeast Asia
LA|라오스|Laos|asia|Southeast Asia
MY|말레이시아|Malaysia|asia|Southeast Asia
MM|미얀마|Myanmar|asia|Southeast Asia
BD|방글라데시|Bangladesh|asia|South Asia
VN|베트남|Vietnam|asia|Southeast Asia
BN|브루나이|Brunei|asia|Southeast Asia
LK|스리랑카|Sri Lanka|asia|South Asia
SG|싱가포르|Singapore|asia|Southeast Asia
IN|인도|India|asia|South Asia
ID|인도네시아|Indonesia|asia|Southeast Asia
JP|일본|Japan|asia|East Asia
CN|중국|China|asia|East Asia
KH|캄보디아|Cambodia|asia|Southeast Asia
TH|태국|Thailand|asia|Southeast Asia
PK|파키스탄|Pakistan|asia|South Asia
PG|파푸아뉴기니|Papua New Guinea|asia|Oceania
PH|필리핀|Philippines|asia|Southeast Asia
GR|그리스|Greece|europe|Southern Europe
NL|네덜란드|Netherlands|europe|Western Europe
NO|노르웨이|Norway|europe|Northern Europe
DK|덴마크|Denmark|europe|Northern Europe
DE|독일|Germany|europe|Western Europe
LV|라트비아|Latvia|europe|Northern Europe
RO|루마니아|Romania|europe|Eastern Europe
LU|룩셈부르크|Luxembourg|europe|Western Europe
LT|리투아니아|Lithuania|europe|Northern Europe
MC|모나코|Monaco|europe|Western Europe
VA|바티칸시국|Vatican City|europe|Southern Europe
BE|벨기에|Belgium|europe|Western Europe
BG|불가리아|Bulgaria|europe|Eastern Europe
RS|세르비아|Serbia|europe|Southern Europe
SE|스웨덴|Sweden|europe|Northern Europe
CH|스위스|Switzerland|europe|Western Europe
ES|스페인|Spain|europe|Southern Europe
SK|슬로바키아|Slovakia|europe|Central Europe
SI|슬로베니아|Slovenia|europe|Southern Europe
IS|아이슬란드|Iceland|europe|Northern Europe
IE|아일랜드|Ireland|europe|Western Europe
EE|에스토니아|Estonia|europe|Northern Europe
GB|영국|United Kingdom|europe|Western Europe
AT|오스트리아|Austria|europe|Central Europe
EU|유럽연합|European Union|europe|European Union
IT|이탈리아|Italy|europe|Southern Europe
CZ|체코|Czech Republic|europe|Central Europe
HR|크로아티아|Croatia|europe|Southern Europe
CY|키프로스|Cyprus|europe|Southern Europe
PT|포르투갈|Portugal|europe|Southern Europe
PL|폴란드|Poland|europe|Central Europe
FR|프랑스|France|europe|Western Europe
FI|핀란드|Finland|europe|Northern Europe
HU|헝가리|Hungary|europe|Central Europe
US|미국|United States|north_america|North America
CA|캐나다|Canada|north_america|North America
GH|가나|Ghana|africa|West Africa
GA|가봉|Gabon|africa|Central Africa
NG|나이지리아|Nigeria|africa|West Africa
ZA|남아프리카공화국|South Africa|africa|Southern Africa
RW|르완다|Rwanda|africa|East Africa
LY|리비아|Libya|africa|North Africa
MA|모로코|Morocco|africa|North Africa
SN|세네갈|Senegal|africa|West Africa
SD|수단|Sudan|africa|North Africa
DZ|알제리|Algeria|africa|North Africa
AO|앙골라|Angola|africa|Central Africa
ET|에티오피아|Ethiopia|africa|East Africa
EG|이집트|Egypt|africa|North Africa
KE|케냐|Kenya|africa|East Africa
CI|코트디부아르|Côte d'Ivoire|africa|West Africa
CD|콩고민주공화국|Democratic Republic of the Congo|africa|Central Africa
TZ|탄자니아|Tanzania|africa|East Africa
TN|튀니지|Tunisia|africa|North Africa
NZ|뉴질랜드|New Zealand|oceania|Oceania
AU|호주|Australia|oceania|Oceania
LB|레바논|Lebanon|middle_east|Middle East
BH|바레인|Bahrain|middle_east|Middle East
SA|사우디아라비아|Saudi Arabia|middle_east|Middle East
AE|아랍에미리트|United Arab Emirates|middle_east|Middle East
OM|오만|Oman|middle_east|Middle East
JO|요르단|Jordan|middle_east|Middle East
IQ|이라크|Iraq|middle_east|Middle East
IR|이란|Iran|middle_east|Middle East
IL|이스라엘|Israel|middle_east|Middle East
QA|카타르|Qatar|middle_east|Middle East
KW|쿠웨이트|Kuwait|middle_east|Middle East
TR|튀르키예|Turkey|middle_east|Middle East
RU|러시아|Russia|russia_central_asia|Russia & Central Asia
MN|몽골|Mongolia|russia_central_asia|Central Asia
BY|벨라루스|Belarus|russia_central_asia|Eastern Europe
AM|아르메니아|Armenia|russia_central_asia|Caucasus
AZ|아제르바이잔|Azerbaijan|russia_central_asia|Caucasus
UZ|우즈베키스탄|Uzbekistan|russia_central_asia|Central Asia
UA|우크라이나|Ukraine|russia_central_asia|Eastern Europe
GE|조지아|Georgia|russia_central_asia|Caucasus
KZ|카자흐스탄|Kazakhstan|russia_central_asia|Central Asia
KG|키르기스스탄|Kyrgyzstan|russia_central_asia|Central Asia
TJ|타지키스탄|Tajikistan|russia_central_asia|Central Asia
TM|투르크메니스탄|Turkmenistan|russia_central_asia|Central Asia
GT|과테말라|Guatemala|latin_america|Central America
DO|도미니카공화국|Dominican Republic|latin_america|Caribbean
MX|멕시코|Mexico|latin_america|Central America
VE|베네수엘라|Venezuela|latin_america|South America
BO|볼리비아|Bolivia|latin_america|South America
BR|브라질|Brazil|latin_america|South America
AR|아르헨티나|Argentina|latin_america|South America
EC|에콰도르|Ecuador|latin_america|South America
SV|엘살바도르|El Salvador|latin_america|Central America
HN|온두라스|Honduras|latin_america|Central America
UY|우루과이|Uruguay|latin_america|South America
CL|칠레|Chile|latin_america|South America
CR|코스타리카|Costa Rica|latin_america|Central America
CO|콜롬비아|Colombia|latin_america|South America
PA|파나마|Panama|latin_america|Central America
PY|파라과이|Paraguay|latin_america|South America
PE|페루|Peru|latin_america|South America
"""
ROWS = [(i, *line.split("|")) for i, line in enumerate(COUNTRIES.split("\n")[1:-1])]
SCHEMA = "place int, code string, name_ko string, name_en string, continent string, region string"


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def valid(code: Column) -> Column:
    """Whether a code is registered, in either case."""
    return F.coalesce(F.upper(code).isin([r[1] for r in ROWS]), F.lit(False))


def enrich(df: DataFrame, code: str = "code", default_continent: str = "Unknown") -> DataFrame:
    """df with the names, continent and region of its code; an unknown code names itself."""
    known = registry(df.sparkSession).select(F.col("code").alias("_c"), "name_ko", "name_en", "continent", "region")
    joined = df.join(F.broadcast(known), F.upper(F.col(code)) == F.col("_c"), "left")  # 118 rows
    named = {n: F.coalesce(n, F.col(code)) for n in ("name_ko", "name_en")}
    return joined.withColumns({**named, "continent": F.coalesce("continent", F.lit(default_continent)), "region": F.coalesce("region", F.lit("Unknown"))}).drop("_c")


def search(countries: DataFrame, term: Column) -> DataFrame:
    """Countries whose names or code contain the term, whatever its case."""
    low = F.lower(term)
    return countries.where(F.lower("name_ko").contains(low) | F.lower("name_en").contains(low) | F.lower("code").contains(low))


def in_region(df: DataFrame, region: str) -> DataFrame:
    """Rows of a region; ``all`` keeps every row."""
    return df if region == "all" else df.where(F.col("region") == region)


def by_continent(countries: DataFrame) -> DataFrame:
    """Each continent with its countries in their order."""
    return countries.groupBy("continent").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda s: s["code"]).alias("codes"))
