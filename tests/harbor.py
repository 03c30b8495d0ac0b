"""Source texts of a made-up harbour office, in the four frameworks."""

TIDES = '''import logging

from fastapi import APIRouter, Depends, FastAPI

log = logging.getLogger("harbour")
berths = APIRouter(prefix="/berths")
tides = APIRouter()
office = FastAPI()
office.include_router(tides, prefix="/tides")
office.include_router(berths)


@berths.put("/{berth}/lock", dependencies=[Depends(verify_token)])
async def lock(berth: str):
    log.info(berth)


@berths.delete("/{berth}")
async def release(berth: str): ...


@tides.get("/{port}/today")
async def today(port, *, unit="m", keeper=Depends(verify_token)):
    return unit


@tides.patch("/{port}")
async def correct(port): ...


@office.head("/")
def ping(): ...
'''

DESK = '''from flask import Blueprint, Flask

desk = Blueprint("desk", __name__)


@desk.route("/crews/<int:crew>", methods=["PUT", "DELETE"])
@jwt_required()
def crew(crew): ...


@desk.route("/crews")
def crews(): ...


@desk.post("/notices")
@cached
def notice(): ...
'''

PILOTS = '''package harbour;

@RestController
public class Pilots {
    @DeleteMapping(path = "/pilots/{no}")
    @Secured("ROLE_MASTER")
    public void dismiss(@PathVariable int no) {}

    @PatchMapping("/pilots/{no}")
    public void rename(@PathVariable int no) {}
}

@RestController
@RequestMapping("/tugs")
public class Tugs {
    @RequestMapping(value = "/{name}/tow", method = RequestMethod.PUT)
    @PreAuthorize("isAuthenticated()")
    public void tow(@PathVariable String name) {}
}
'''

QUAY = '''const quay = express();
const cranes = require('./cranes');
quay.use('/cranes', requireAuth, cranes);
quay.all('/horn', (req, res) => res.end());
'''

CRANES = '''const cranes = express.Router();
cranes.route('/:crane').put(limit(5), move).delete(scrap);
module.exports = cranes;
'''
