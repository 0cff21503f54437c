"""Schemas of the data model: geometries, features, feature sets and places records."""

from __future__ import annotations

SR = "struct<wkid:bigint,latest_wkid:bigint,vcs_wkid:bigint,latest_vcs_wkid:bigint,wkt:string>"
POINT = f"struct<x:double,y:double,z:double,m:double,spatialReference:{SR}>"
MULTIPOINT = f"struct<hasZ:boolean,hasM:boolean,points:array<array<double>>,spatialReference:{SR}>"
POLYLINE = f"struct<hasZ:boolean,hasM:boolean,paths:array<array<array<double>>>,spatialReference:{SR}>"
POLYGON = f"struct<hasZ:boolean,hasM:boolean,rings:array<array<array<double>>>,spatialReference:{SR}>"
ENVELOPE = f"struct<xmin:double,ymin:double,xmax:double,ymax:double,zmin:double,zmax:double,mmin:double,mmax:double,spatialReference:{SR}>"

#: Any geometry in one column: kind says which members count.
GEOM = (
    "struct<kind:string,x:double,y:double,z:double,m:double,hasZ:boolean,hasM:boolean,"
    "points:array<array<double>>,rings:array<array<array<double>>>,paths:array<array<array<double>>>,"
    f"xmin:double,ymin:double,xmax:double,ymax:double,zmin:double,zmax:double,mmin:double,mmax:double,spatialReference:{SR}>"
)

FIELD = "struct<name:string,type:string,alias:string,sqlType:string,domain:variant,defaultValue:variant>"

CATEGORY = "struct<categoryId:string,label:string>"
CATEGORY_DETAILS = "struct<categoryId:string,fullLabel:array<string>,icon:struct<url:string>,parents:array<string>>"
ICON = "struct<url:string>"
XY = "struct<x:double,y:double>"
PLACE_RESULT = f"struct<categories:array<{CATEGORY}>,distance:double,icon:{ICON},location:{XY},name:string,placeId:string>"
EXTENT_RESULT = f"struct<categories:array<{CATEGORY}>,icon:{ICON},location:{XY},name:string,placeId:string>"
TIME_RANGE = "struct<from:string,to:string>"
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
HOURS_BY_DAY = "struct<" + ",".join(f"{d}:array<{TIME_RANGE}>" for d in _DAYS) + ">"
HOURS = f"struct<opening:{HOURS_BY_DAY},openingText:string,popular:{HOURS_BY_DAY}>"
ADDRESS = (
    "struct<adminRegion:string,censusBlockId:string,country:string,designatedMarketArea:string,extended:string,locality:string,"
    "neighborhood:array<string>,poBox:string,postcode:string,postTown:string,region:string,streetAddress:string>"
)
CONTACT = "struct<email:string,fax:string,telephone:string,website:string>"
RATING = "struct<price:string,user:double>"
SOCIAL = "struct<facebookId:string,instagram:string,twitter:string>"
ADDITIONAL_LOCATIONS = f"struct<dropOff:{XY},frontDoor:{XY},road:{XY},roof:{XY}>"
PLACE_DETAILS = (
    f"struct<additionalLocations:{ADDITIONAL_LOCATIONS},address:{ADDRESS},categories:array<{CATEGORY}>,chains:array<struct<name:string>>,contactInfo:{CONTACT},"
    f"description:string,hours:{HOURS},icon:{ICON},location:{XY},name:string,placeId:string,rating:{RATING},socialMedia:{SOCIAL}>"
)
ERROR = "struct<code:bigint,details:array<string>,message:string,restInfoUrl:string>"


def columns_of(struct: str) -> str:
    """The members of a struct type as a table schema, which has spaces for colons."""
    out, depth, name = [], 0, True
    for c in struct.removeprefix("struct<").removesuffix(">"):
        depth += (c == "<") - (c == ">")
        if depth == 0 and c == ":" and name:
            c, name = " ", False
        elif depth == 0 and c == ",":
            name = True
        out.append(c)
    return "".join(out)
