"""Units of measure: aliases, dimensions and exact factors to the base units of `metric_dims`.

The aliases and factors are fixed values: international definitions (inch 25.4 mm, pound 453.59237 g, conventional
millimetre of mercury 133.322387415 Pa).
"""

from __future__ import annotations

from fractions import Fraction

#: unit -> (dimension, factor to the base unit, offset added before the factor)
UNITS: dict[str, tuple[str, Fraction, Fraction]] = {}
#: (alias, unit, case matters)
ALIASES: list[tuple[str, str, bool]] = []


def _unit(name: str, dimension: str, factor: str, aliases: str, exact: str = "", offset: str = "0") -> None:
    UNITS[name] = (dimension, Fraction(factor), Fraction(offset))
    ALIASES.extend((a.strip(), name, False) for a in aliases.split(";") if a.strip())
    ALIASES.extend((a.strip(), name, True) for a in exact.split(";") if a.strip())


_unit("us", "duration", "1", "us;µs;μs;usec;microsecond;microseconds;微秒")
_unit("ms", "duration", "1000", "ms;msec;msecs;millisecond;milliseconds;毫秒")
_unit("s", "duration", "1000000", "s;sec;secs;sec.;secs.;second;seconds;秒;秒钟")
_unit("min", "duration", "60000000", "min;mins;min.;mins.;minute;minutes;分钟;分")
_unit("h", "duration", "3600000000", "h;hr;hrs;hr.;hrs.;hour;hours;小时;时")
_unit("d", "duration", "86400000000", "d;day;days;天;日")
_unit("wk", "duration", "604800000000", "wk;wks;w;week;weeks;周;星期")
_unit("ug", "mass", "1", "ug;µg;μg;mcg;microgram;micrograms;微克")
_unit("mg", "mass", "1000", "mg;mgs;milligram;milligrams;milligramme;milligrammes;毫克")
_unit("g", "mass", "1000000", "g;gm;gms;gr;gram;grams;gramme;grammes;克")
_unit("kg", "mass", "1000000000", "kg;kgs;kilo;kilos;kilogram;kilograms;kilogramme;kilogrammes;公斤;千克")
_unit("t", "mass", "1000000000000", "tonne;tonnes;吨")
_unit("lb", "mass", "453592370", "lb;lbs;lb.;lbs.;pound;pounds;磅")
_unit("oz", "mass", "28349523.125", "oz;ounce;ounces;盎司")
_unit("um", "length", "1", "um;µm;μm;micron;microns;micrometer;micrometers;micrometre;micrometres;微米")
_unit("mm", "length", "1000", "mm;millimeter;millimeters;millimetre;millimetres;毫米")
_unit("cm", "length", "10000", "cm;cms;centimeter;centimeters;centimetre;centimetres;厘米;公分")
_unit("m", "length", "1000000", "m;meter;meters;metre;metres;米")
_unit("km", "length", "1000000000", "km;kms;kilometer;kilometers;kilometre;kilometres;公里;千米")
_unit("in", "length", "25400", "in;in.;inch;inches;英寸")
_unit("ft", "length", "304800", "ft;ft.;foot;feet;英尺")
_unit("yd", "length", "914400", "yd;yard;yards;码")
_unit("mi", "length", "1609344000", "mi;mile;miles;英里")
_unit("Pa", "pressure", "1", "pa;pascal;pascals;帕;帕斯卡")
_unit("hPa", "pressure", "100", "hpa;mbar;mbars;millibar;millibars;hectopascal;hectopascals;百帕;毫巴")
_unit("kPa", "pressure", "1000", "kpa;kilopascal;kilopascals;千帕")
_unit("MPa", "pressure", "1000000", "megapascal;megapascals;兆帕", exact="MPa")
_unit("bar", "pressure", "100000", "bar;bars;巴")
_unit("mmHg", "pressure", "133.322387415", "mmhg;mm hg;mm of mercury;毫米汞柱")
_unit("atm", "pressure", "101325", "atm;atmosphere;atmospheres;大气压")
_unit("psi", "pressure", "8896443230521/1290320000", "psi")
_unit("mdegC", "temperature", "1", "mdegc;millidegree celsius;millidegrees celsius")
_unit("degC", "temperature", "1000", "c;°c;℃;celsius;deg c;degc;degree celsius;degrees celsius;centigrade;摄氏度;摄氏")
_unit("degF", "temperature", "5000/9", "f;°f;℉;fahrenheit;deg f;degf;degree fahrenheit;degrees fahrenheit;华氏度;华氏", offset="-32")
_unit("K", "temperature", "1000", "k;kelvin;kelvins;°k;开尔文;开", offset="-273.15")
_unit("ppm", "proportion", "1", "ppm;parts per million;per million;百万分之")
_unit("fraction", "proportion", "1000000", "fraction;proportion;ratio")
_unit("percent", "proportion", "10000", "%;％;﹪;pct;pct.;percent;per cent;percentage;百分比;百分之")
_unit("permille", "proportion", "1000", "‰;per mille;per mil;permille;per 1000;per 1,000;per thousand;/1000;/1k;千分之;千分比")
_unit("per100k", "proportion", "10", "per 100,000;per 100 000;per 100000;/100k;/100,000;/100000;per 100k;每10万;每十万")
_unit("per10k", "proportion", "100", "per 10,000;per 10 000;per 10000;/10k;‱;bp;万分之")
_unit("ppb", "proportion", "1/1000", "ppb;parts per billion;per billion")
_unit("ug/L", "concentration", "1", "ug/l;µg/l;μg/l;mcg/l;ng/ml;微克/升;微克每升")
_unit("mg/L", "concentration", "1000", "mg/l;ug/ml;µg/ml;μg/ml;mcg/ml;毫克/升;毫克每升")
_unit("mg/dL", "concentration", "10000", "mg/dl;mg%;mg %;毫克/分升")
_unit("g/L", "concentration", "1000000", "g/l;mg/ml;克/升;克每升")
_unit("g/dL", "concentration", "10000000", "g/dl;克/分升")
_unit("ug/dL", "concentration", "10", "ug/dl;µg/dl;μg/dl;mcg/dl")
_unit("ng/L", "concentration", "1/1000", "ng/l;pg/ml")
_unit("count", "quantity", "1", "count;counts;个;items;tokens;documents;词;条")
_unit("thousand", "quantity", "1000", "k;thousand;thousands;千")
_unit("wan", "quantity", "10000", "万")
_unit("million", "quantity", "1000000", "m;mn;mln;mio;million;millions;百万")
_unit("yi", "quantity", "100000000", "亿")
_unit("billion", "quantity", "1000000000", "bn;b;billion;billions;十亿")


def dimension_names() -> list[str]:
    return sorted({d for d, _, _ in UNITS.values()})
